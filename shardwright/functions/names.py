"""Built-in column expressions over paths, part names and small byte facts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Report categories of part names, in order of precedence.
CATEGORIES = [
    ("slide_xml", r"^ppt/slides/slide\d+\.xml$"),
    ("slide_rels", r"^ppt/slides/_rels/"),
    ("notes", r"^ppt/notesSlides/"),
    ("media", r"^ppt/media/"),
    ("layout_master", r"^ppt/(slideLayouts|slideMasters|theme)/"),
    ("core_parts", r"^(\[Content_Types\]\.xml|_rels/\.rels|ppt/presentation\.xml|ppt/_rels/presentation\.xml\.rels)$"),
    ("docProps", r"^docProps/"),
]
# Parts that a package must have.
CORE_PARTS = ["[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml"]
# Suffixes of targets, of legacy files and of archives.
TARGET_SUFFIXES = [".pptx", ".pptm"]
LEGACY_SUFFIX = ".ppt"
ARCHIVES = r"\.(zip|tar|tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|txz|enex)$"
ALIGNMENTS = [1 << 20, 1 << 18, 1 << 16, 1 << 12]
#: Flags of files that are not on disk yet.
CLOUD_FLAGS, CLOUD_ATTRIBUTES = 0x40000000, 0x00440000


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """The last dot segment in lower case; a leading dot starts no suffix, a trailing one neither."""
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


def is_archive(name: Column) -> Column:
    return F.lower(name).rlike(ARCHIVES)


def is_placeholder(st_flags: Column, attributes: Column) -> Column:
    """A cloud file without local bytes."""
    at = lambda c, mask: F.coalesce(c, F.lit(0)).bitwiseAND(F.lit(mask)) != 0
    return at(st_flags, CLOUD_FLAGS) | at(attributes, CLOUD_ATTRIBUTES)


def bucket(name: Column, size: Column, placeholder: Column, *, ignore_hidden: bool = False, collect_archives: bool = True, allow_download: bool = False, max_bytes: int | None = None) -> Column:
    """Where a file goes; null: nowhere. The first rule that fits decides."""
    kind = suffix(name)
    archive = is_archive(name) if collect_archives else F.lit(False)
    target = kind.isin(TARGET_SUFFIXES)
    relevant = target | (kind == LEGACY_SUFFIX) | archive
    cloud = placeholder & F.lit(not allow_download)
    rules = F.when(name.startswith("~$"), "skipped_temp")
    if ignore_hidden:
        rules = rules.when(name.startswith("."), F.when(relevant, "skipped_hidden"))
    rules = rules.when(kind == LEGACY_SUFFIX, "skipped_legacy")
    rules = rules.when(archive, F.when(cloud, "skipped_cloud").otherwise("archives"))
    rules = rules.when(~target, None).when(cloud, "skipped_cloud")
    if max_bytes is not None:
        rules = rules.when(size > max_bytes, "skipped_oversize")
    return rules.otherwise("targets")


def is_download(bucket_name: Column, placeholder: Column) -> Column:
    return placeholder & bucket_name.isin("targets", "archives")


def categorize(name: Column) -> Column:
    out = F.when(name.rlike(CATEGORIES[0][1]), CATEGORIES[0][0])
    for label, pattern in CATEGORIES[1:]:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise("other")


def slide_number(name: Column) -> Column:
    """null if the part is no slide."""
    digits = F.regexp_extract(name, r"^ppt/slides/slide(\d+)\.xml$", 1)
    return F.when(digits != "", digits.try_cast("int"))


def alignment(value: Column) -> Column:
    """The largest of the known block sizes that divides a value; null if none does."""
    out = F.when(value % ALIGNMENTS[0] == 0, ALIGNMENTS[0])
    for n in ALIGNMENTS[1:]:
        out = out.when(value % n == 0, n)
    return out.cast("long")


def head_kind(content: Column) -> Column:
    """zip, cfb, zeros or other, from the first eight bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304"), "zip").when(head == "D0CF11E0A1B11AE1", "cfb").when(head.startswith("00000000"), "zeros").otherwise("other")


def size_label(n: Column) -> Column:
    """Bytes for people."""
    tenths = lambda unit: F.call_function("format_number", n / F.lit(float(unit)), F.lit("0.0"))
    return (
        F.when(n >= 1 << 20, F.concat(tenths(1 << 20), F.lit(" MiB")))
        .when(n >= 1 << 10, F.concat(tenths(1 << 10), F.lit(" KiB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def file_key(path: Column) -> Column:
    """Twelve hex digits that stand for a path."""
    return F.substring(F.sha2(path, 256), 1, 12)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def member_name(index: Column, name: Column) -> Column:
    """A numbered, safe file name for an archive's member."""
    return F.format_string("member%04d-%s", index, safe_name(basename(name)))


def flat_xml_name(name: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("/"), F.lit("__")), ":", "_"), r"^\.+", "")
    return F.concat(F.regexp_replace(flat, r"\.[^.]*$", ""), F.lit(".partial.xml"))


# Content types by suffix, and of parts by their names; the first rule that fits decides.
CONTENT_TYPES = {
    "rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "avi": "video/avi", "mp3": "audio/mpeg", "m4a": "audio/mp4", "wav": "audio/wav",
    "bin": "application/vnd.openxmlformats-officedocument.oleObject", "thmx": "application/vnd.openxmlformats-officedocument.themeManager+xml",
}
OTHER_TYPE = "application/octet-stream"
PART_TYPES = [
    (r"^ppt/presentation\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"),
    (r"^ppt/slides/slide\d+\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.slide+xml"),
    (r"^ppt/slideMasters/[^/]+\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.slideMaster+xml"),
    (r"^ppt/slideLayouts/[^/]+\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.slideLayout+xml"),
    (r"^ppt/notesSlides/[^/]+\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.notesSlide+xml"),
    (r"^ppt/notesMasters/[^/]+\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.notesMaster+xml"),
    (r"^ppt/theme/[^/]+\.xml$", "application/vnd.openxmlformats-officedocument.theme+xml"),
    (r"^ppt/presProps\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.presProps+xml"),
    (r"^ppt/viewProps\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.viewProps+xml"),
    (r"^ppt/tableStyles\.xml$", "application/vnd.openxmlformats-officedocument.presentationml.tableStyles+xml"),
    (r"^docProps/core\.xml$", "application/vnd.openxmlformats-package.core-properties+xml"),
    (r"^docProps/app\.xml$", "application/vnd.openxmlformats-officedocument.extended-properties+xml"),
    (r"^ppt/charts/chart\d+\.xml$", "application/vnd.openxmlformats-officedocument.drawingml.chart+xml"),
]


def default_type(ending: Column) -> Column:
    """The content type of a suffix (without its dot)."""
    kinds = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, F.lower(ending)), F.lit(OTHER_TYPE))


def part_type(name: Column) -> Column:
    """The content type that a part's own name gives it; null where its suffix decides."""
    out = F.when(name.rlike(PART_TYPES[0][0]), PART_TYPES[0][1])
    for pattern, kind in PART_TYPES[1:]:
        out = out.when(name.rlike(pattern), kind)
    return out


def is_unsafe_path(name: Column) -> Column:
    """Absolute, with a drive letter, or climbing."""
    return name.rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")


def is_unsafe_name(name: Column) -> Column:
    """As a path below a rescue folder: absolute, with any colon (drives and streams), climbing, or without a usable step."""
    return name.rlike(r"^[/\\]|:|(^|[/\\])\.\.([/\\]|$)") | ~name.rlike(r"(^|[/\\])(?!\.?([/\\]|$))[^/\\]")


def flat_unsafe_name(name: Column, number: Column) -> Column:
    """A flat name for such an entry, told apart by its number."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\:]*)[/\\:]*$", 1), r"^\.\.?$", "")
    return F.concat(F.lit("_unsafe_"), F.lpad(number.cast("string"), 4, "0"), F.lit("_"), F.when(base == "", "entry").otherwise(base))


def rels_name(part: Column) -> Column:
    """The relationship part of a part."""
    folder = dirname(part)
    return F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit("_rels/"), basename(part), F.lit(".rels"))


def rels_base(rels_part: Column) -> Column:
    """The folder that a relationship part's targets start from."""
    return F.regexp_extract(rels_part, r"^(?:(.*)/)?_rels/[^/]*$", 1)


def normalised(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` steps; what climbs past the top is dropped."""
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved(base: Column, target: Column) -> Column:
    """A relationship's target as a part name."""
    return normalised(F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", base, target)))


def type_tail(kind: Column) -> Column:
    return F.substring_index(kind, "/", -1)


def local_name(tag: Column) -> Column:
    """A tag without its namespace in braces."""
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def text_runs(xml: Column) -> Column:
    """Non-empty contents of text-run elements, unescaped."""
    runs = F.regexp_extract_all(xml, F.lit(r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>"), F.lit(1))
    return F.filter(F.transform(runs, unescaped), lambda t: t != "")


def paragraphs(xml: Column) -> Column:
    """Texts of paragraphs, the runs of each joined; paragraphs without text are left out."""
    inner = F.regexp_extract_all(xml, F.lit(r"(?s)<a:p(?:\s[^>]*)?>(.*?)</a:p>"), F.lit(1))
    return F.filter(F.transform(inner, lambda p: F.array_join(text_runs(p), "")), lambda t: t != "")


def _unescaped_named(text: Column) -> Column:
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def unescaped(text: Column) -> Column:
    """The five named references and numeric ones as characters; what is decoded is not decoded again."""
    number = r"^&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));"

    def piece(p: Column) -> Column:
        digits = F.when(F.regexp_extract(p, number, 1) != "", F.regexp_extract(p, number, 1)).when(F.regexp_extract(p, number, 2) != "", F.conv(F.regexp_extract(p, number, 2), 10, 16))
        code = F.lpad(digits, 8, "0")
        fits = code.isNotNull() & (code > "00000000") & (F.upper(code) <= "0010FFFF") & ~F.upper(code).between("0000D800", "0000DFFF")
        return F.when(fits, F.concat(F.decode(F.unhex(code), "UTF-32"), _unescaped_named(F.regexp_replace(p, number, "")))).otherwise(_unescaped_named(p))

    return F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, r"(?=&#)"), piece), "")).otherwise(_unescaped_named(text))


def dos_datetime(date: Column, time: Column) -> Column:
    """A container's packed date and time; null if no such moment exists."""
    year, month, day = F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(F.lit(15)), date.bitwiseAND(F.lit(31))
    hour, minute, second = F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(F.lit(63)), time.bitwiseAND(F.lit(31)) * 2
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second), F.lit("yyyy-MM-dd HH:mm:ss"))


def block_class(zeros: Column, printable: Column, n: Column, entropy: Column) -> Column:
    """What a block of bytes looks like: counts of zero and of printable bytes, length, bits a byte."""
    return F.when(zeros == n, "zeros").when(printable >= 0.95 * n, "text_like").when(entropy >= 7.0, "high_entropy").otherwise("other")


def strict_base64(text: Column) -> Column:
    """Decoded bytes; null for anything that is no base64."""
    return F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("base64"))


def composed(text: Column) -> Column:
    """Unicode NFC form, by which names are compared: a file system may hand back letters and their accents apart."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return nfc(text)
