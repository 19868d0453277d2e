"""Whatever can still be read from a package that cannot be repaired."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.functions.names import flat_xml_name, paragraphs, unescaped
from shardwright.operators.repair import carve
from shardwright.session import file_batches
from shardwright.sources.packages import read_parts

PARTIAL_MIN, PARTIAL_MAX = 256, 30 << 20
# Headings of slide titles, in the languages that are known.
TITLE_HEADINGS = ["Slide Titles", "スライド タイトル"]

#: Rows of one chart's table at most: what a sheet can hold.
CHART_ROWS = 1 << 20


def prefix_of(data: bytes) -> bytes:
    """As much of a broken deflate stream as inflates, up to the bound."""
    z, out, at = zlib.decompressobj(-15), bytearray(), 0
    step = 4096
    while at < len(data) and not z.eof and len(out) < PARTIAL_MAX:
        keep = z.copy()
        try:
            out += z.decompress(data[at : at + step], PARTIAL_MAX - len(out))
            at += step
        except zlib.error:
            z = keep
            if step == 1:
                break
            step = max(1, step // 8)
    return bytes(out)


def partial_xml(files: DataFrame) -> DataFrame:
    """(file_id, name, path, payload): beginnings of XML parts that the index lists and that no longer verify.

    ``files``: file_id, content, cd. Parts are cut out in their file's row, so no file moves.
    """
    at = lambda e: e["header_offset"].cast("int")
    number = lambda b: F.conv(F.concat(F.hex(F.substring(b, F.lit(2), F.lit(1))), F.hex(F.substring(b, F.lit(1), F.lit(1)))), 16, 10).cast("int")
    head = lambda e: F.substring("content", at(e) + 1, F.lit(30))
    sound = lambda e: (F.hex(F.substring(head(e), F.lit(1), F.lit(4))) == "504B0304") & (number(F.substring(head(e), F.lit(9), F.lit(2))) == 8)
    body = lambda e: F.substring("content", at(e) + 31 + number(F.substring(head(e), F.lit(27), F.lit(2))) + number(F.substring(head(e), F.lit(29), F.lit(2))), e["comp_size"].cast("int"))
    failed = F.filter("cd", lambda e: ~e["ok"] & e["name"].rlike(r"\.(xml|rels)$"))
    cut = F.transform(failed, lambda e: F.struct(e["name"].alias("name"), F.when(sound(e), body(e)).alias("body")))
    bodies = file_batches(files.select("file_id", F.explode(cut).alias("e")).where("e.body is not null").select("file_id", "e.name", "e.body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_of(b.as_py() or b"") for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["file_id", "name", "payload"])

    kind = files.schema["file_id"].dataType.simpleString()
    made = bodies.mapInArrow(run, f"file_id {kind}, name string, payload binary").where(F.octet_length("payload") >= PARTIAL_MIN)
    return made.select("file_id", "name", flat_xml_name(F.col("name")).alias("path"), "payload")


def rescue(files: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """(file_id, stage, path, length, digest): entries, carved images, beginnings of XML, and texts, each on its own. ``diagnosed`` of ``files``; with their bytes kept, no file is shuffled."""
    one = lambda df, stage, path, payload: df.select("file_id", F.lit(stage).alias("stage"), path.alias("path"), F.octet_length(payload).cast("long").alias("length"), F.sha2(payload, 256).alias("digest"))
    parts = read_parts(files)
    held = diagnosed if "content" in diagnosed.columns else diagnosed.select("file_id", "cd").join(files, "file_id")
    broken = partial_xml(held.select("file_id", "content", "cd"))
    images = carve(files).select("file_id", F.lit("carve").alias("stage"), F.format_string("image%04d.%s", "image_no", "kind").alias("path"), "length", "digest")
    xml = parts.where(F.col("name").rlike(r"^ppt/(slides|notesSlides)/[^/]+\.xml$")).select("file_id", "name", "payload").unionByName(broken.select("file_id", "name", "payload"))
    texts = xml.withColumn("text", F.array_join(paragraphs(F.col("payload").cast("string")), "\n").cast("binary")).where(F.octet_length("text") > 0)
    return one(parts, "entries", F.col("name"), F.col("payload")).unionByName(images).unionByName(one(broken, "partial", F.col("path"), F.col("payload"))).unionByName(one(texts, "text", F.concat("name", F.lit(".txt")), F.col("text")))


def core_properties(parts: DataFrame) -> DataFrame:
    """(file_id, title, creator, modified_by, created, modified) from docProps/core.xml."""
    xml = F.col("payload").cast("string")
    value = lambda tag: F.when(xml.rlike(rf"<(?:\w+:)?{tag}[\s>]"), unescaped(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</", 1)))
    return parts.where("name = 'docProps/core.xml'").select("file_id", *(value(t).alias(a) for t, a in (("title", "title"), ("creator", "creator"), ("lastModifiedBy", "modified_by"), ("created", "created"), ("modified", "modified"))))


def slide_titles(parts: DataFrame) -> DataFrame:
    """(file_id, title_no, title, sliced): slide titles that docProps/app.xml lists, by the counts of its headings; all its titles (sliced false) if none of the headings is known."""
    xml = parts.where("name = 'docProps/app.xml'").select("file_id", F.col("payload").cast("string").alias("xml"))
    inside = lambda tag: F.regexp_extract("xml", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    strings = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<vt:lpstr>(.*?)</vt:lpstr>"), F.lit(1)), unescaped)
    counts = F.transform(F.regexp_extract_all(inside("HeadingPairs"), F.lit(r"<vt:i4>(\d+)</vt:i4>"), F.lit(1)), lambda n: n.cast("int"))
    base = xml.select("file_id", strings(inside("HeadingPairs")).alias("headings"), counts.alias("counts"), strings(inside("TitlesOfParts")).alias("titles"))
    places = [F.nullif(F.array_position("headings", h), F.lit(0)) for h in TITLE_HEADINGS]
    at = F.coalesce(F.least(*places), F.lit(0)).cast("int")  # least skips nulls
    offset = F.aggregate(F.slice("counts", F.lit(1), F.greatest(at - 1, F.lit(0))), F.lit(0), lambda n, c: n + c)
    sliced = (at > 0) & (F.size("counts") >= at)
    own = F.when(sliced, F.slice("titles", offset + 1, F.try_element_at("counts", F.greatest(at, F.lit(1))))).otherwise(F.col("titles"))
    return base.select("file_id", sliced.alias("sliced"), F.posexplode(own).alias("n", "title")).select("file_id", (F.col("n") + 1).alias("title_no"), "title", "sliced")


def chart_points(parts: DataFrame) -> DataFrame:
    """(file_id, chart, series_no, series, idx, category, value): cached points of charts, a row each; a pivot on series makes the table."""
    charts = parts.where(F.col("name").rlike(r"^ppt/charts/chart\d+\.xml$")).select("file_id", F.col("name").alias("chart"), F.col("payload").cast("string").alias("xml"))
    series = charts.select("file_id", "chart", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<c:ser>(.*?)</c:ser>"), F.lit(1))).alias("series_no", "s"))
    block = lambda tag: F.regexp_extract("s", rf"(?s)<c:{tag}>(.*?)</c:{tag}>", 1)
    points = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<c:pt idx=\"(\d+)\"[^>]*>.*?</c:pt>"), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, r"idx=\"(\d+)\"", 1).cast("int").alias("idx"), unescaped(F.regexp_extract(p, r"(?s)<c:v>(.*?)</c:v>", 1)).alias("v")))
    rows = series.select("file_id", "chart", "series_no", unescaped(F.regexp_extract(block("tx"), r"(?s)<c:v>(.*?)</c:v>", 1)).alias("series"), points(block("cat")).alias("cats"), F.explode(points(block("val"))).alias("p"))
    category = F.get(F.transform(F.filter("cats", lambda c: c["idx"] == F.col("p.idx")), lambda c: c["v"]), F.lit(0))
    return rows.select("file_id", "chart", "series_no", "series", F.col("p.idx").alias("idx"), category.alias("category"), F.col("p.v").alias("value"))


def chart_tables(parts: DataFrame) -> DataFrame:
    """(file_id, chart, row, cells): every chart's cached points as the rows of a table, the heading first: a category and a value of each series; what has no point is empty, and indices
    without any point are empty rows, up to ``CHART_ROWS`` of them."""
    points = chart_points(parts).where(F.col("idx") < CHART_ROWS)
    key = ["file_id", "chart"]
    series = points.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("series_no", "series"))).alias("all"))  # series of one chart
    at = points.groupBy(*key, "idx").agg(F.max("category").alias("category"), F.collect_list(F.struct("series_no", "value")).alias("held"))
    value = lambda s: F.coalesce(F.get(F.transform(F.filter("held", lambda h: h["series_no"] == s["series_no"]), lambda h: h["value"]), F.lit(0)), F.lit(""))
    every = at.groupBy(*key).agg(F.max("idx").alias("_top")).select(*key, F.explode(F.sequence(F.lit(0), "_top")).alias("idx"))
    at = every.join(at, [*key, "idx"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<series_no:int,value:string>>")))
    body = at.join(series, key).select(*key, (F.col("idx") + 1).alias("row"), F.concat(F.array(F.coalesce("category", F.lit(""))), F.transform("all", value)).alias("cells"))
    head = series.select(*key, F.lit(0).alias("row"), F.concat(F.array(F.lit("")), F.transform("all", lambda s: F.coalesce(s["series"], F.lit("")))).alias("cells"))
    return head.unionByName(body)


def csv_lines(tables: DataFrame) -> DataFrame:
    """(file_id, chart, row, line): rows of ``chart_tables`` as CSV; cells with a comma, a quote or a line end are quoted."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return tables.select("file_id", "chart", "row", F.array_join(F.transform("cells", cell), ",").alias("line"))


def stage_counts(rescued: DataFrame) -> DataFrame:
    return rescued.groupBy("stage").agg(F.count("*").alias("n"))
