"""Relations of files and entries made from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NAME = "CASE l_partkey % 5 WHEN 0 THEN 'ppt/slides/slide' || (l_partkey % 40 + 1) || '.xml' WHEN 1 THEN 'ppt/media/image' || (l_partkey % 90) || '.png' WHEN 2 THEN 'ppt/notesSlides/notesSlide' || (l_partkey % 7) || '.xml' WHEN 3 THEN 'docProps/app.xml' ELSE 'ppt/theme/theme1.xml' END"
_ENTRY = f"l_orderkey AS file_id, {_NAME} AS name, CAST(l_linenumber AS BIGINT) * 1000 AS header_offset, l_partkey AS crc, CAST(l_quantity AS BIGINT) AS comp_size, l_discount < 0.08 AS ok, CASE WHEN l_discount < 0.08 OR l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN 'BadCRC' WHEN l_linenumber % 4 = 2 THEN 'error' ELSE 'Truncated' END AS error"
ENTRIES = f"SELECT 'cd' AS method, {_ENTRY} FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'lfh' AS method, {_ENTRY} FROM lineitem WHERE l_tax < 0.05"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    one = lambda method, cond: lines.where(cond).selectExpr(f"'{method}' AS method", *_split(_ENTRY))
    return one("cd", "l_returnflag <> 'R'").union(one("lfh", "l_tax < 0.05"))


def _split(text: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


PATHS = "SELECT source || '/' || CASE doc_id % 7 WHEN 0 THEN '~$' WHEN 1 THEN '.' ELSE '' END || 'f' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.pptx' WHEN 1 THEN '.PPTM' WHEN 2 THEN '.ppt' WHEN 3 THEN '.zip' WHEN 4 THEN '.tar.gz' ELSE '.txt' END AS path, n_chars AS size, doc_id % 11 = 0 AS cloud FROM documents"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_split(PATHS.removeprefix("SELECT ").removesuffix(" FROM documents")))


FILES = "SELECT d.doc_id AS file_id, source AS name, n_chars AS size, quality = 1 AS normal FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select(F.col("doc_id").alias("file_id"), F.col("source").alias("name"), F.col("n_chars").alias("size"), (F.col("quality") == 1).alias("normal"))


PARTS = "SELECT doc_id AS file_id, 'part' || i AS name, sha256(line) AS crc, CAST(length(line) AS BIGINT) AS comp_size, length(line) >= 200 AS media FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE line <> ''"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where("line <> ''")
    return lines.select("file_id", F.concat(F.lit("part"), (F.col("i") + 1).cast("string")).alias("name"), F.sha2(F.col("line").cast("binary"), 256).alias("crc"), F.length("line").cast("long").alias("comp_size"), (F.length("line") >= 200).alias("media"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("size"))


#: All pairs of class representatives that share a triple or their size, scored.
SCORES = f"""
p0 AS (SELECT DISTINCT * FROM ({PARTS})),
k AS (SELECT d.doc_id AS file_id, n_chars AS size, md5(string_agg(name || crc, ',' ORDER BY name, crc)) AS k FROM documents d LEFT JOIN p0 ON p0.file_id = d.doc_id GROUP BY ALL),
reps AS (SELECT file_id, size FROM (SELECT file_id, size, CASE WHEN k IS NULL THEN file_id ELSE min(file_id) OVER (PARTITION BY size, k) END AS c FROM k) WHERE file_id = c),
p AS (SELECT p0.* FROM p0 JOIN reps USING (file_id)),
pairs AS (SELECT a.file_id AS target, b.file_id AS donor FROM p a JOIN p b ON a.name = b.name AND a.crc = b.crc AND a.comp_size = b.comp_size WHERE a.file_id <> b.file_id UNION SELECT a.file_id, b.file_id FROM reps a JOIN reps b ON a.size = b.size AND a.file_id <> b.file_id),
n AS (SELECT reps.file_id, size, count(DISTINCT (name, crc, comp_size)) FILTER (name IS NOT NULL) AS nt, count(DISTINCT name) AS nn, count(DISTINCT name) FILTER (media) AS nm FROM reps LEFT JOIN p USING (file_id) GROUP BY ALL),
st AS (SELECT target, donor, count(*) AS st, count(*) FILTER (a.media AND b.media) AS sm FROM pairs JOIN p a ON a.file_id = target JOIN p b ON b.file_id = donor AND a.name = b.name AND a.crc = b.crc AND a.comp_size = b.comp_size GROUP BY ALL),
sn AS (SELECT target, donor, count(*) AS sn FROM pairs JOIN p a ON a.file_id = target JOIN p b ON b.file_id = donor AND a.name = b.name GROUP BY ALL),
rat AS (SELECT pairs.target, pairs.donor, x.size IS NOT DISTINCT FROM y.size AS size_match, x.nm > 0 AND y.nm > 0 AS both_media,
  CASE WHEN greatest(x.nt, y.nt) > 0 THEN coalesce(st, 0) / CAST(greatest(x.nt, y.nt) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS triple_ratio, CASE WHEN greatest(x.nn, y.nn) > 0 THEN coalesce(sn, 0) / CAST(greatest(x.nn, y.nn) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS name_ratio,
  CASE WHEN greatest(x.nm, y.nm) > 0 THEN coalesce(sm, 0) / CAST(greatest(x.nm, y.nm) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS media_ratio
  FROM pairs LEFT JOIN st ON st.target = pairs.target AND st.donor = pairs.donor LEFT JOIN sn ON sn.target = pairs.target AND sn.donor = pairs.donor JOIN n x ON x.file_id = pairs.target JOIN n y ON y.file_id = pairs.donor),
ls AS (SELECT *, CASE WHEN both_media THEN CAST(0.5 AS DOUBLE) * media_ratio + CAST(0.3 AS DOUBLE) * triple_ratio + CAST(0.2 AS DOUBLE) * name_ratio ELSE CAST(0.6 AS DOUBLE) * triple_ratio + CAST(0.4 AS DOUBLE) * name_ratio END AS lineage_score FROM rat),
scored AS (SELECT target, donor, size_match, triple_ratio, name_ratio, media_ratio, lineage_score, CASE WHEN size_match AND triple_ratio >= CAST(0.95 AS DOUBLE) THEN 'auto' WHEN size_match AND name_ratio >= CAST(0.7 AS DOUBLE) THEN 'candidate' WHEN NOT size_match AND lineage_score >= CAST(0.8 AS DOUBLE) THEN 'lineage' ELSE 'rejected' END AS tier FROM ls)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS group_id", "'e' || l_linenumber AS name", "l_suppkey AS copy_rank", "l_orderkey AS entry_seq", "l_discount < 0.05D AS ok")


def missing_and_donors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    name, size = "'p' || l_linenumber AS name", "CAST(l_quantity AS BIGINT) AS file_size"
    missing = lines.where("l_returnflag = 'R'").selectExpr("l_orderkey AS target", name, "l_partkey AS crc", size).distinct()
    donors = lines.where("l_returnflag <> 'R'").selectExpr("l_orderkey AS donor", "l_suppkey AS donor_rank", name, "l_partkey AS crc", size, "l_tax < 0.05D AS valid").distinct()
    return missing, donors


_REF = "user_id AS file_id, 'ppt/slides/slide' || (event_id % 9 + 1) || '.xml' AS part, 'r:id' AS attribute, 'rId' || (event_id % 11) AS rid"
REFS = f"SELECT {_REF} FROM events"
_REL = "o_custkey AS file_id, 'ppt/slides/_rels/slide' || (o_orderkey % 9 + 1) || '.xml.rels' AS rels_part, 'rId' || (o_orderkey % 11) AS rid, CASE WHEN o_orderkey % 3 = 0 THEN 'slideLayout' ELSE 'image' END AS type_tail, 'ppt/slides/slide' || (o_orderkey % 9 + 1) || '.xml' AS resolved, o_orderkey % 5 = 0 AS external"
RELS = f"SELECT {_REL} FROM orders"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split(_REF))


def rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_split(_REL))
