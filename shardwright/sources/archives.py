"""Members of archives and note exports as rows."""

from __future__ import annotations

import base64
import io
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.functions.names import is_archive
from shardwright.session import file_batches

SUFFIXES = (".pptx", ".pptm")
# Types that stand for a presentation, and the suffix each gets.
MIME = {
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.ms-powerpoint.presentation.macroenabled.12": ".pptm",
}
Member = tuple[str | None, bytes | None, str | None]


def _wanted(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return base.lower().endswith(SUFFIXES) and not base.startswith("~$")


def zip_members(data: bytes) -> Iterator[Member]:
    """(name, content, note) in recorded order; a member that can't be read is a note."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if info.is_dir() or not _wanted(info.filename):
                continue
            if info.flag_bits & 1:
                yield info.filename, None, "encrypted"
                continue
            try:
                yield info.filename, archive.read(info), None
            except Exception as e:
                yield info.filename, None, f"unreadable: {type(e).__name__}"


def tar_members(data: bytes) -> Iterator[Member]:
    """One forward pass; what was read before an error stays."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as archive:
        for info in archive:
            if info.isfile() and _wanted(info.name):
                yield info.name, archive.extractfile(info).read(), None


def enex_members(data: bytes, decode: bool = True) -> Iterator[Member]:
    """Attachments of a note export: by their file name, else by their type; names carry the note's title."""
    title, ordinal = "(untitled)", 0
    for event, node in ET.iterparse(io.BytesIO(data), events=("start", "end")):
        tag = node.tag.rsplit("}", 1)[-1]
        if event == "start" and tag == "note":
            title = "(untitled)"
        elif event == "end" and tag == "title":
            title = (node.text or "").strip() or "(untitled)"
        elif event == "end" and tag == "resource":
            ordinal += 1
            name, mime = node.findtext(".//file-name"), (node.findtext("mime") or "").strip().lower()
            if name and not _wanted(name) or not name and mime not in MIME:
                node.clear()
                continue
            label = f"{title}/{name or f'resource{ordinal}{MIME[mime]}'}"
            try:
                yield label, base64.b64decode("".join((node.findtext("data") or "").split()), validate=True) if decode else None, None
            except ValueError:
                yield label, None, "bad base64"
            node.clear()


def members(name: str, data: bytes) -> Iterator[Member]:
    """The presentations in an archive; an archive that breaks off ends with a note."""
    low = name.lower()
    reader = enex_members if low.endswith(".enex") else zip_members if low.endswith(".zip") else tar_members
    try:
        yield from reader(data)
    except Exception as e:
        yield None, None, f"archive ends early: {type(e).__name__}"


def mine_archives(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path_col, member_no, member, size, content, note) of the archives among ``files``; other files give nothing.

    One task holds one archive and one member at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(path_col, pa.string()), ("member_no", pa.int64()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("note", pa.string())])
        for batch in batches:
            for path, content in zip(*(batch.column(c) for c in (0, 1))):
                for n, (member, data, note) in enumerate(members(path.as_py(), content.as_py() or b"")):
                    yield pa.RecordBatch.from_pylist([{path_col: path.as_py(), "member_no": n, "member": member, "size": None if data is None else len(data), "content": data, "note": note}], schema=schema)

    archives = files.where(is_archive(F.col(path_col))).select(F.col(path_col).cast("string"), F.col(content_col).cast("binary"))
    return file_batches(archives).mapInArrow(run, f"{path_col} string, member_no bigint, member string, size bigint, content binary, note string")


def listed(name: str, data: bytes) -> Iterator[Member]:
    """The names that ``members`` would give, without reading a member: an index or headers are enough, and attachments stay undecoded."""
    low = name.lower()
    try:
        if low.endswith(".enex"):
            yield from ((label, None, note) for label, _, note in enex_members(data, decode=False))
        elif low.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                yield from ((i.filename, None, "encrypted" if i.flag_bits & 1 else None) for i in archive.infolist() if not i.is_dir() and _wanted(i.filename))
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as archive:
                yield from ((i.name, None, None) for i in archive if i.isfile() and _wanted(i.name))
    except Exception as e:
        yield None, None, f"archive ends early: {type(e).__name__}"


def list_archives(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path_col, member_no, member, note) of the archives among ``files``: names only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(path_col, pa.string()), ("member_no", pa.int64()), ("member", pa.string()), ("note", pa.string())])
        for batch in batches:
            for path, content in zip(*(batch.column(c) for c in (0, 1))):
                rows = [{path_col: path.as_py(), "member_no": n, "member": m, "note": note} for n, (m, _, note) in enumerate(listed(path.as_py(), content.as_py() or b""))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    archives = files.where(is_archive(F.col(path_col))).select(F.col(path_col).cast("string"), F.col(content_col).cast("binary"))
    return file_batches(archives).mapInArrow(run, f"{path_col} string, member_no bigint, member string, note string")


def chosen_members(mined: DataFrame, wanted: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """The mined rows that ``wanted`` (path_col, member) names, and the wanted ones that aren't there."""
    return mined.join(wanted, [path_col, "member"], "left_semi"), wanted.join(mined.select(path_col, "member"), [path_col, "member"], "left_anti")
