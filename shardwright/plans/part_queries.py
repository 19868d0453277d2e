"""Queries over names, XML parts and reports, with their SQL.

Parts are made from the driver's tables as XML text, the same in both engines,
so that the SQL knows what an operator must find in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.functions import names as N
from shardwright.operators import classify, integrity, repair, report, rescue, salvage
from shardwright.plans import stand_ins as S
from shardwright.plans.registry import query
from shardwright.sources.archives import chosen_members
from shardwright.sources.containers import RECIPES, known_packages
from shardwright.sources.packages import read_parts
from shardwright.session import stored

RECIPE = f"list_extract([{', '.join(repr(r) for r in RECIPES)}], CAST(doc_id % {len(RECIPES)} AS BIGINT) + 1)"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_packages(S.table(spark, sf_dir, "documents"))


# --- names and scalars


@query("SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MiB', n / CAST(1048576 AS DOUBLE)) WHEN n >= 1024 THEN printf('%.1f KiB', n / CAST(1024 AS DOUBLE)) ELSE n || ' bytes' END AS label FROM (SELECT doc_id, n_chars * (doc_id % 3) * 977 AS n FROM documents)")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", N.size_label(F.col("n_chars") * (F.col("doc_id") % 3) * 977).alias("label"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') AS safe, printf('member%04d-%s', CAST(p_partkey AS INTEGER), regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g')) AS member FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select("p_partkey", N.safe_name(F.col("p_name")).alias("safe"), N.member_name(F.col("p_partkey"), F.concat(F.lit("a/b/"), "p_name")).alias("member"))


@query(f"WITH e AS ({S.ENTRIES}) SELECT DISTINCT name, replace(regexp_replace(name, '[.][^.]*$', ''), '/', '__') || '.partial.xml' AS flat FROM e")
def flat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.entries(spark, sf_dir).select("name", N.flat_xml_name(F.col("name")).alias("flat")).distinct()


_TARGET = "CASE o_orderkey % 5 WHEN 0 THEN '../media/image' || o_custkey || '.png' WHEN 1 THEN '/ppt/media/x' || o_custkey WHEN 2 THEN './a/../b' || o_custkey WHEN 3 THEN '../../../../c' ELSE 'charts//chart' || o_custkey || '.xml' END"


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ppt/media/image' || o_custkey || '.png' WHEN 1 THEN 'ppt/media/x' || o_custkey WHEN 2 THEN 'ppt/slides/b' || o_custkey WHEN 3 THEN 'c' ELSE 'ppt/slides/charts/chart' || o_custkey || '.xml' END AS resolved FROM orders")
def resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select("o_orderkey", N.resolved(F.lit("ppt/slides"), F.expr(_TARGET)).alias("resolved"))


@query("SELECT DISTINCT lower(event_type) AS type_tail, upper(event_type) AS local_name FROM events")
def type_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = N.type_tail(F.concat(F.lit("http://example.org/relationships/"), F.lower("event_type")))
    return S.table(spark, sf_dir, "events").select(tail.alias("type_tail"), N.local_name(F.concat(F.lit("{http://example.org/ns}"), F.upper("event_type"))).alias("local_name")).distinct()


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN sha256(text) END AS digest FROM documents")
def base64_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.base64(F.col("text").cast("binary"))
    given = F.when(F.col("doc_id") % 3 == 0, coded).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(coded, 1, 5), F.lit("\n "), F.substring(coded, 6, 1 << 30))).otherwise(F.concat(F.lit("!"), coded))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.sha2(N.strict_base64(given), 256).alias("digest"))


_STAMP = "printf('%04d-%02d-%02d %02d:%02d:%02d', CAST((d >> 9) + 1980 AS INTEGER), CAST((d >> 5) & 15 AS INTEGER), CAST(d & 31 AS INTEGER), CAST(t >> 11 AS INTEGER), CAST((t >> 5) & 63 AS INTEGER), CAST((t & 31) * 2 AS INTEGER))"


@query(f"WITH s AS (SELECT o_orderkey, CAST(o_orderkey * 37 % 65536 AS BIGINT) AS d, CAST(o_custkey * 91 % 65536 AS BIGINT) AS t FROM orders) SELECT o_orderkey, CASE WHEN (t >> 11) < 24 AND (t & 31) < 30 AND ((t >> 5) & 63) < 60 THEN strftime(try_cast({_STAMP} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS moment FROM s")
def packed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = N.dos_datetime((F.col("o_orderkey") * 37 % 65536).cast("int"), (F.col("o_custkey") * 91 % 65536).cast("int"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("moment"))


def _align(v: str) -> str:
    return f"CASE WHEN {v} % 1048576 = 0 THEN '1048576' WHEN {v} % 262144 = 0 THEN '262144' WHEN {v} % 65536 = 0 THEN '65536' WHEN {v} % 4096 = 0 THEN '4096' ELSE 'none' END"


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey * 1024 AS a, l_partkey * 1024 + l_suppkey * 4096 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, a || '@' || {_align('a')} || '/' || b || '@' || {_align('b')} AS label FROM r")
def zero_run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") * 1024
    runs = F.array(F.struct(start.alias("start"), (start + F.col("l_suppkey") * 4096).alias("end")))
    rows = S.table(spark, sf_dir, "lineitem").withColumn("zero_runs", runs)
    return rows.select("l_orderkey", "l_linenumber", report.zero_run_labels(rows).alias("label"))


@query("""
SELECT p_partkey, p_size || list_extract(['', 'kb', '.5M', ' GB', 'T', 'x'], CAST(p_partkey % 6 AS BIGINT) + 1) AS text,
  CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024::BIGINT WHEN 2 THEN floor((p_size + 0.5) * 1048576) WHEN 4 THEN p_size * 1099511627776 END AS BIGINT) AS bytes FROM part""")
def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*(F.lit(u) for u in ("", "kb", ".5M", " GB", "T", "x"))), (F.col("p_partkey") % 6).cast("int"))
    rows = S.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("text"))
    return rows.withColumn("bytes", report.size_bytes(F.col("text")))


_LABELS = f"CASE {RECIPE} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.LABELS.items()) + " END"


@query(f"SELECT {_LABELS} AS label, count(*) AS n FROM documents GROUP BY 1")
def verdict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(r) for r in RECIPES))
    return S.table(spark, sf_dir, "documents").groupBy(report.verdict_label(F.get(names, (F.col("doc_id") % len(RECIPES)).cast("int"))).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'a' || chr(38) || 'b < ' || chr(8364) || CAST(doc_id AS VARCHAR) || ' ' || chr(38) || 'lt; ' || chr(128512) AS text FROM documents")
def character_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("a&#38;b &lt; &#x20ac;"), F.col("doc_id").cast("string"), F.lit(" &#38;lt; &#128512;"))
    return S.table(spark, sf_dir, "documents").select("doc_id", N.unescaped(given).alias("text"))


_PARAGRAPHS = "list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')"


@query(f"SELECT doc_id, len({_PARAGRAPHS}) AS n, sha256(array_to_string({_PARAGRAPHS}, chr(10))) AS digest FROM documents")
def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a paragraph whose runs are cut in the middle."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    run = lambda t: F.concat(F.lit("<a:r><a:t>"), t, F.lit("</a:t></a:r>"))
    half = lambda p: F.instr(p, " ")
    lines = F.filter(F.split(text, "\n", -1), lambda p: F.trim(p) != "")
    xml = F.array_join(F.transform(lines, lambda p: F.concat(F.lit("<a:p>"), run(F.substring(p, F.lit(1), half(p))), run(F.substring(p, half(p) + 1, F.length(p))), F.lit("</a:p>"))), "")
    found = S.table(spark, sf_dir, "documents").select("doc_id", N.paragraphs(xml).alias("p"))
    return found.select("doc_id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "\n").cast("binary"), 256).alias("digest"))


# --- document properties, titles and charts


def _part(df: DataFrame, key: str, name: str, *xml) -> DataFrame:
    return df.select(F.col(key).alias("file_id"), F.lit(name).alias("name"), F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xml)).cast("binary").alias("payload"))


@query("SELECT doc_id AS file_id, source || ' & ' || doc_id AS title, lang AS creator, CAST(n_chars AS VARCHAR) AS created FROM documents")
def document_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part(S.table(spark, sf_dir, "documents"), "doc_id", "docProps/core.xml", "<cp:coreProperties><dc:title>", F.col("source"), " &amp; ", F.col("doc_id"), "</dc:title><dc:creator>", F.col("lang"), "</dc:creator><dcterms:created xsi:type=\"dcterms:W3CDTF\">", F.col("n_chars"), "</dcterms:created></cp:coreProperties>")
    return rescue.core_properties(parts).select("file_id", "title", "creator", "created")


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, c_custkey % 3 < 2 AS sliced FROM customer), t AS (SELECT c_custkey, sliced, n, unnest(range(0, 2 + n)) AS i FROM c)
SELECT c_custkey AS file_id, CAST(CASE WHEN sliced THEN i - 1 ELSE i + 1 END AS INTEGER) AS title_no, CASE WHEN i = 0 THEN 'Theme A' WHEN i = 1 THEN 'Theme B' ELSE 'Slide ' || (i - 1) || ' of ' || c_custkey END AS title, sliced FROM t WHERE NOT sliced OR i > 1""")
def title_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, heading = F.col("c_custkey") % 4, F.when(F.col("c_custkey") % 3 == 0, "Slide Titles").when(F.col("c_custkey") % 3 == 1, "スライド タイトル").otherwise("Folientitel")
    titles = F.array_join(F.transform(F.sequence(F.lit(0), n + 1), lambda i: F.concat(F.lit("<vt:lpstr>"), F.when(i == 0, "Theme A").when(i == 1, "Theme B").otherwise(F.concat(F.lit("Slide "), (i - 1).cast("string"), F.lit(" of "), F.col("c_custkey").cast("string"))), F.lit("</vt:lpstr>"))), "")
    pair = lambda label, count: (F.lit("<vt:variant><vt:lpstr>"), label, F.lit("</vt:lpstr></vt:variant><vt:variant><vt:i4>"), count.cast("string"), F.lit("</vt:i4></vt:variant>"))
    parts = _part(S.table(spark, sf_dir, "customer"), "c_custkey", "docProps/app.xml", "<Properties><HeadingPairs><vt:vector>", *pair(F.lit("Theme"), F.lit(2)), *pair(heading, n), "</vt:vector></HeadingPairs><TitlesOfParts><vt:vector>", titles, "</vt:vector></TitlesOfParts></Properties>")
    return rescue.slide_titles(parts)





@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier)
SELECT k AS file_id, CAST(0 AS INTEGER) AS "row", ',"North, ' || k || '",South' AS line FROM s
UNION ALL SELECT k, 1, 'q1,' || v || ',' || (v + 1) FROM s UNION ALL SELECT k, 2, 'q2,' || (v * 2) || ',' FROM s""")
def chart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series of a chart, the second without its last point."""
    k, v = F.col("s_suppkey"), F.col("s_nationkey")
    point = lambda i, x: F.concat(F.lit(f'<c:pt idx="{i}"><c:v>'), x.cast("string"), F.lit("</c:v></c:pt>"))
    cats = F.concat(F.lit("<c:cat>"), point(0, F.lit("q1")), point(1, F.lit("q2")), F.lit("</c:cat>"))
    series = lambda name, *points: F.concat(F.lit("<c:ser><c:tx><c:v>"), name, F.lit("</c:v></c:tx>"), cats, F.lit("<c:val>"), *points, F.lit("</c:val></c:ser>"))
    parts = _part(S.table(spark, sf_dir, "supplier"), "s_suppkey", "ppt/charts/chart1.xml", "<c:chart>", series(F.concat(F.lit("North, "), k.cast("string")), point(0, v), point(1, v * 2)), series(F.lit("South"), point(0, v + 1)), "</c:chart>")
    return rescue.csv_lines(rescue.chart_tables(parts)).select("file_id", "row", "line")


# --- integrity of parts


@query("SELECT o_orderkey AS file_id, 'ppt/slides/slide1.xml' AS part, CAST(o_custkey % 5 AS VARCHAR) AS spid FROM orders WHERE o_custkey % 5 NOT IN (o_orderkey % 5, 9)")
def dangling_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part(S.table(spark, sf_dir, "orders"), "o_orderkey", "ppt/slides/slide1.xml", '<p:sld><p:cNvPr id="', F.col("o_orderkey") % 5, '" name="x"/><p:cNvPr name="y" id="9"/><p:spTgt spid="', F.col("o_custkey") % 5, '"/></p:sld>')
    return integrity.shape_references(parts)


@query("SELECT o_orderkey AS file_id, 'ppt/slides/slide1.xml' AS part, CASE WHEN o_custkey % 2 = 0 THEN 'video' ELSE 'audio' END AS kind, '4' AS spid FROM orders WHERE (o_custkey % 2 = 0) <> (o_orderkey % 2 = 0)")
def media_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timing tree that plays a video or a sound from a picture that holds one or the other."""
    play, held = F.when(F.col("o_custkey") % 2 == 0, "video").otherwise("audio"), F.when(F.col("o_orderkey") % 2 == 0, "video").otherwise("audio")
    parts = _part(S.table(spark, sf_dir, "orders"), "o_orderkey", "ppt/slides/slide1.xml", '<p:sld><p:pic><p:cNvPr id="4" name="m"/><a:', held, 'File r:link="rId1"/></p:pic><p:timing><p:', play, '><p:tgtEl><p:spTgt spid="4"/></p:tgtEl></p:', play, "></p:timing></p:sld>")
    return integrity.media_mismatches(parts)


@query("SELECT o_orderkey AS file_id, 'ppt/slideMasters/slideMaster1.xml' AS part, 'ppt/theme/theme' || (o_custkey % 3) || '.xml' AS theme FROM orders WHERE o_custkey % 3 <> o_orderkey % 3")
def missing_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    rels = integrity.relationships(_part(orders, "o_orderkey", "ppt/slideMasters/_rels/slideMaster1.xml.rels", '<Relationships><Relationship Id="rId1" Type="http://x/theme" Target="../theme/theme', F.col("o_custkey") % 3, '.xml"/><Relationship Id="rId2" Type="http://x/theme" TargetMode="External" Target="http://y/z"/></Relationships>'))
    names = orders.select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("ppt/theme/theme"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".xml")).alias("name"))
    return integrity.missing_themes(names, rels)


_KINDS = ["ppt/slides/slide1.xml", "ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml", "ppt/notesMasters/notesMaster1.xml", "ppt/notesSlides/notesSlide1.xml", "ppt/presentation.xml"]
_TAILS = ["slideLayout", "slideMaster", "theme", "slide", "notesMaster"]


@query(f"""
WITH p AS (SELECT p_partkey AS file_id, list_extract({_KINDS!r}, CAST(p_partkey % 6 AS BIGINT) + 1) AS part, list_extract({_TAILS!r}, CAST(p_size % 5 AS BIGINT) + 1) AS have FROM part),
r(part, required) AS (VALUES ('{_KINDS[0]}', 'slideLayout'), ('{_KINDS[1]}', 'slideMaster'), ('{_KINDS[2]}', 'theme'), ('{_KINDS[3]}', 'theme'), ('{_KINDS[4]}', 'slide'), ('{_KINDS[4]}', 'notesMaster'), ('{_KINDS[5]}', 'slideMaster'))
SELECT file_id, part, required FROM p JOIN r USING (part) WHERE required <> have""")
def required_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, at: F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))
    rows = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), pick(_KINDS, F.col("p_partkey") % 6).alias("name"), pick(_TAILS, F.col("p_size") % 5).alias("type_tail"))
    return integrity.missing_relationships(rows.select("file_id", "name"), rows.select("file_id", N.rels_name(F.col("name")).alias("rels_part"), "type_tail"))


@query(f"""
WITH d AS (SELECT file_id, part FROM ({S.REFS}) r WHERE NOT EXISTS (SELECT 1 FROM ({S.RELS}) l WHERE l.file_id = r.file_id AND l.rid = r.rid AND l.rels_part = 'ppt/slides/_rels/' || string_split(r.part, '/')[-1] || '.rels'))
SELECT file_id, count(*) AS n, count(DISTINCT part) AS n_parts, array_to_string(list_sort(list(DISTINCT part)), ' ') AS parts FROM d GROUP BY file_id""")
def integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = integrity.summary(integrity.dangling_references(S.refs(spark, sf_dir), S.rels(spark, sf_dir)))
    return found.withColumn("parts", F.array_join("parts", " "))


# --- repaired packages


_REBUILT = f"SELECT doc_id AS file_id, {RECIPE} = 'interior_damage' AS lost FROM documents WHERE {RECIPE} IN ('tail_truncated', 'interior_damage', 'version_mix')"
_CT = "application/vnd.openxmlformats-officedocument."


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _known(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "content")
    return read_parts(repair.repair(files).where("mode = 'rebuild'").select("file_id", "content"))


@query(f"""
WITH d AS ({_REBUILT}), p(part, content_type, slide1) AS (VALUES ('_rels/.rels', 'application/vnd.openxmlformats-package.relationships+xml', false), ('ppt/presentation.xml', '{_CT}presentationml.presentation.main+xml', false), ('ppt/_rels/presentation.xml.rels', 'application/vnd.openxmlformats-package.relationships+xml', false),
  ('ppt/slides/slide1.xml', '{_CT}presentationml.slide+xml', true), ('ppt/slides/slide2.xml', '{_CT}presentationml.slide+xml', false), ('ppt/slides/slide3.xml', '{_CT}presentationml.slide+xml', false),
  ('ppt/slides/_rels/slide1.xml.rels', 'application/vnd.openxmlformats-package.relationships+xml', false), ('ppt/slides/_rels/slide2.xml.rels', 'application/vnd.openxmlformats-package.relationships+xml', false), ('ppt/slides/_rels/slide3.xml.rels', 'application/vnd.openxmlformats-package.relationships+xml', false),
  ('ppt/slideLayouts/slideLayout1.xml', '{_CT}presentationml.slideLayout+xml', false), ('ppt/media/image1.bin', '{_CT}oleObject', false), ('docProps/app.xml', '{_CT}extended-properties+xml', false), ('docProps/core.xml', 'application/vnd.openxmlformats-package.core-properties+xml', false), ('ppt/presProps.xml', '{_CT}presentationml.presProps+xml', false))
SELECT part, content_type, count(*) AS n FROM d JOIN p ON NOT (lost AND slide1) GROUP BY ALL""")
def rebuilt_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.content_types(_repaired(spark, sf_dir)).groupBy("part", "content_type").agg(F.count("*").alias("n"))


@query(f"WITH d AS ({_REBUILT}) SELECT file_id, CAST(CASE WHEN lost THEN 2 ELSE 3 END AS BIGINT) AS n_slides, CAST(CASE WHEN lost THEN 2 ELSE 3 END AS BIGINT) AS n_listed, CAST(0 AS BIGINT) AS n_dangling FROM d")
def rebuilt_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of rebuilt decks, ids in their lists, and references that lead nowhere."""
    parts = stored(integrity.readable_parts(_repaired(spark, sf_dir)), "parts")
    rels = integrity.relationships(parts)
    lost = integrity.pruned_relationships(rels, parts.select("file_id", "name")).where("not keep").select("file_id").unionByName(integrity.dangling_references(integrity.references(parts), rels).select("file_id"))
    listed = parts.where("name = 'ppt/presentation.xml'").select("file_id", F.size(F.regexp_extract_all(F.col("payload").cast("string"), F.lit(repair.IDS), F.lit(1))).cast("long").alias("n_listed"))
    slides = parts.groupBy("file_id").agg(F.count_if(N.slide_number(F.col("name")).isNotNull()).alias("n_slides"))
    n = lost.groupBy("file_id").agg(F.count("*").alias("n"))
    return slides.join(listed, "file_id").join(n, "file_id", "left").select("file_id", "n_slides", "n_listed", F.coalesce("n", F.lit(0)).cast("long").alias("n_dangling"))


@query("SELECT doc_id AS file_id, CAST(1 AS BIGINT) AS image_no, 'png' AS kind, CAST(100 + doc_id % 7 AS BIGINT) AS \"offset\", CAST(32 + 9000 + doc_id % 5 AS BIGINT) AS length FROM documents WHERE doc_id % 4 <> 0")
def carved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of some 9,000 bytes behind a few letters; every fourth one is cut off."""
    n = 9000 + F.col("doc_id") % 5
    chunk = lambda kind, size, body: (F.unhex(F.lpad(F.hex(size), 8, "0")), F.lit(kind).cast("binary"), body, F.unhex(F.lit("00000000")))
    data = lambda size: F.repeat(F.lit("q"), size.cast("int")).cast("binary")
    whole = F.concat(data(100 + F.col("doc_id") % 7), F.unhex(F.lit("89504E470D0A1A0A")), *chunk("IDAT", n, data(n)), *chunk("IEND", F.lit(0), F.lit("").cast("binary")), F.lit("rest").cast("binary"))
    cut = F.when(F.col("doc_id") % 4 == 0, F.substring(whole, 1, 5000)).otherwise(whole)
    return repair.carve(S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), cut.alias("content"))).select("file_id", "image_no", "kind", "offset", "length")


@query("""
WITH m AS (SELECT DISTINCT l_orderkey AS target, 'p' || l_linenumber AS name FROM lineitem WHERE l_returnflag = 'R'), d AS (SELECT DISTINCT l_orderkey AS donor, l_suppkey AS donor_rank, 'p' || l_linenumber AS name FROM lineitem WHERE l_returnflag <> 'R' AND l_tax < 0.05),
f AS (SELECT name, donor, row_number() OVER (PARTITION BY name ORDER BY donor_rank, donor) AS r FROM d)
SELECT target, name, donor FROM m JOIN f USING (name) WHERE r = 1""")
def donors_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing, donors = S.missing_and_donors(spark, sf_dir)
    return salvage.donors_by_name(missing.select("target", "name").distinct(), donors)


@query("""
WITH m AS (SELECT DISTINCT 'a' || l_orderkey % 50 AS path, 'e' || l_linenumber AS member FROM lineitem WHERE l_returnflag <> 'R'), w AS (SELECT DISTINCT 'a' || l_orderkey % 60 AS path, 'e' || l_linenumber AS member FROM lineitem WHERE l_returnflag = 'R' OR l_orderkey % 60 > 55)
SELECT path, member, 'chosen' AS state FROM m SEMI JOIN w USING (path, member) UNION ALL SELECT path, member, 'absent' FROM w ANTI JOIN m USING (path, member)""")
def requested_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "lineitem")
    rows = lambda cond, n: lines.where(cond).selectExpr(f"'a' || l_orderkey % {n} AS path", "'e' || l_linenumber AS member").distinct()
    chosen, absent = chosen_members(rows("l_returnflag <> 'R'", 50), rows("l_returnflag = 'R' or l_orderkey % 60 > 55", 60))
    return chosen.withColumn("state", F.lit("chosen")).unionByName(absent.withColumn("state", F.lit("absent")))


# --- reports


@query(f"SELECT doc_id, {RECIPE} AS verdict, '3' AS schema_version FROM documents")
def file_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = report.file_rows(classify.diagnose(_known(spark, sf_dir)), "doc_id")
    return made.select("doc_id", F.get_json_object("report", "$.verdict").alias("verdict"), F.get_json_object("report", "$.schema_version").alias("schema_version"))


@query(f"SELECT CAST(1 AS INTEGER) AS section, doc_id, doc_id || ': ' || {_LABELS} AS line FROM documents WHERE doc_id % 17 <> 0 AND {RECIPE} <> 'normal' UNION ALL SELECT 2, doc_id, doc_id || ': not read, ValueError: no content' FROM documents WHERE doc_id % 17 = 0")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged files by label, then those that could not be read; the notes in brackets are cut off here."""
    files = _known(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 17 != 0, F.col("content")))
    lines = report.text_lines(classify.diagnose(files), "doc_id")
    return lines.withColumn("line", F.regexp_replace("line", r" \(size .*\)$", ""))


@query(f"SELECT CASE {RECIPE} WHEN 'other_corrupt' THEN 'other_corrupt' ELSE 'not_a_zip' END AS verdict, count(*) AS n FROM documents WHERE {RECIPE} IN ('other_corrupt', 'not_a_zip') GROUP BY 1")
def unknown_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.diagnose(_known(spark, sf_dir)).where(classify.is_unknown_pattern()).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN count(*) FILTER ({RECIPE} <> 'normal') > 0 THEN 1 ELSE 0 END AS exit_code FROM documents")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.exit_code(classify.diagnose(_known(spark, sf_dir)))


@query(f"""
WITH f AS ({S.FILES}), t AS (SELECT * FROM f WHERE NOT normal), d AS (SELECT * FROM f WHERE normal),
m AS (SELECT t.file_id AS target, d.file_id AS donor, CASE WHEN t.name = d.name AND t.size = d.size THEN 1 WHEN t.size = d.size THEN 2 ELSE 3 END AS tier FROM t JOIN d ON t.name = d.name UNION SELECT t.file_id, d.file_id, CASE WHEN t.name = d.name THEN 1 ELSE 2 END FROM t JOIN d ON t.size = d.size),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, donor) AS rank FROM m), l AS (SELECT target, list(donor ORDER BY rank) AS a FROM r WHERE rank <= 10 GROUP BY target)
SELECT t.file_id, array_to_string(a[1:3], ' ') AS shown, CAST(greatest(len(a) - 3, 0) AS INTEGER) AS more FROM t JOIN l ON l.target = t.file_id""")
def shown_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shardwright.operators.link import twin_candidates

    files = S.files(spark, sf_dir)
    judged = files.select("file_id", F.when(F.col("normal"), "normal").otherwise("other_corrupt").alias("verdict"), (~F.col("normal")).alias("corrupted"))
    shown = report.with_candidates(judged, twin_candidates(files), "file_id").where("twins_shown is not null")
    return shown.select("file_id", F.array_join(F.col("twins_shown").cast("array<string>"), " ").alias("shown"), "more")
