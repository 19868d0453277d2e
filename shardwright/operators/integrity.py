"""References inside packages: relations of parts, and anti-joins that find what dangles."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.functions import xmltree
from shardwright.functions.names import rels_base, rels_name, resolved, type_tail, unescaped

# Parts and the relationship types that each must have.
REQUIRED = [
    (r"^ppt/slides/slide\d+\.xml$", ["slideLayout"]),
    (r"^ppt/slideLayouts/slideLayout\d+\.xml$", ["slideMaster"]),
    (r"^ppt/slideMasters/slideMaster\d+\.xml$", ["theme"]),
    (r"^ppt/notesMasters/notesMaster\d+\.xml$", ["theme"]),
    (r"^ppt/notesSlides/notesSlide\d+\.xml$", ["slide", "notesMaster"]),
    (r"^ppt/presentation\.xml$", ["slideMaster"]),
]
ORPHANS = [("slide", r"^ppt/slides/slide\d+\.xml$"), ("notes", r"^ppt/notesSlides/notesSlide\d+\.xml$")]


def _attribute(element: Column, name: str) -> Column:
    value = F.regexp_extract(element, rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.when(value != "", unescaped(value))


_RELATIONSHIP = r"(?s)<(?:\w+:)?Relationship\s[^>]*>"


def _relationship(rels_part: Column, element: Column) -> list[Column]:
    """rid, type_tail, target, resolved and external of one element."""
    external = F.coalesce(_attribute(element, "TargetMode") == "External", F.lit(False))
    target = _attribute(element, "Target")
    return [
        _attribute(element, "Id").alias("rid"), type_tail(_attribute(element, "Type")).alias("type_tail"), target.alias("target"),
        F.when(~external, resolved(rels_base(rels_part), target)).alias("resolved"), external.alias("external"),
    ]


def relationships(parts: DataFrame) -> DataFrame:
    """(file_id, rels_part, rid, type_tail, target, resolved, external) of every relationship. ``parts``: file_id, name, payload."""
    rels = parts.where(F.col("name").endswith(".rels")).select("file_id", F.col("name").alias("rels_part"), F.col("payload").cast("string").alias("xml"))
    each = rels.select("file_id", "rels_part", F.explode(F.regexp_extract_all("xml", F.lit(_RELATIONSHIP), F.lit(0))).alias("e"))
    return each.select("file_id", "rels_part", *_relationship(F.col("rels_part"), F.col("e")))


def relationships_of(parts: Column) -> Column:
    """``relationships`` of one file's ``parts``, an array of (name, payload): an array of (rels_part, rid, ...)."""
    elements = lambda p: F.coalesce(F.regexp_extract_all(p["payload"].cast("string"), F.lit(_RELATIONSHIP), F.lit(0)), F.array().cast("array<string>"))
    found = F.transform(F.filter(parts, lambda p: p["name"].endswith(".rels")), lambda p: F.transform(elements(p), lambda e: F.struct(p["name"].alias("rels_part"), e.alias("e"))))
    return F.transform(F.flatten(found), lambda r: F.struct(r["rels_part"].alias("rels_part"), *_relationship(r["rels_part"], r["e"])))


def readable_parts(parts: DataFrame) -> DataFrame:
    """``parts`` (file_id, name, payload) with the payloads that inspectors read: of XML and relationship parts. Media are named only."""
    text = F.col("name").endswith(".xml") | F.col("name").endswith(".rels")
    return parts.select("file_id", "name", F.when(text, F.col("payload")).alias("payload"))


_INSPECTED = pa.struct([
    ("refs", pa.list_(pa.struct([("attribute", pa.string()), ("rid", pa.string())]))), ("lost_shapes", pa.list_(pa.string())),
    ("mismatches", pa.list_(pa.struct([("kind", pa.string()), ("spid", pa.string())]))),
])


def inspections(parts: DataFrame) -> DataFrame:
    """(file_id, part, found) of every XML part but relationship parts; ``found`` (refs, lost_shapes, mismatches) is null where a part isn't well-formed. One parse a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(2):
                try:
                    found.append(xmltree.once(xmltree.inspected, data.as_py() or b""))
                except ExpatError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _INSPECTED)], names=["file_id", "part", "found"])

    xml = parts.where(F.col("name").endswith(".xml")).select("file_id", F.col("name").alias("part"), F.col("payload").cast("binary"))
    kind = parts.schema["file_id"].dataType.simpleString()
    return xml.mapInArrow(run, f"file_id {kind}, part string, found struct<refs:array<struct<attribute:string,rid:string>>,lost_shapes:array<string>,mismatches:array<struct<kind:string,spid:string>>>")


def references(parts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(file_id, part, attribute, rid): all attributes of the relationship namespace in XML parts, named r:... whatever their prefix; empty values are none. ``seen``: the parts' inspections, if they are stored."""
    return (inspections(parts) if seen is None else seen).select("file_id", "part", F.explode("found.refs").alias("r")).select("file_id", "part", "r.attribute", "r.rid")


def unreadable(parts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(file_id, part) of XML parts that aren't well-formed."""
    return (inspections(parts) if seen is None else seen).where("found is null").select("file_id", "part")


def without_relationships(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_id, part, n): parts that refer to relationships but have no relationship part, and how many references they hold."""
    there = names.where(F.col("name").endswith(".rels")).select("file_id", F.col("name").alias("rels_part")).distinct()
    return refs.withColumn("rels_part", rels_name(F.col("part"))).join(there, ["file_id", "rels_part"], "left_anti").groupBy("file_id", "part").agg(F.count("*").alias("n"))


def dangling_references(refs: DataFrame, rels: DataFrame) -> DataFrame:
    """References whose id the part's relationships don't define (external ones count; without a relationship part all dangle)."""
    defined = rels.select("file_id", "rels_part", "rid").distinct()
    return refs.withColumn("rels_part", rels_name(F.col("part"))).join(defined, ["file_id", "rels_part", "rid"], "left_anti").select("file_id", "part", "attribute", "rid")


def missing_relationships(names: DataFrame, rels: DataFrame) -> DataFrame:
    """(file_id, part, required): parts that lack a relationship of a required type. ``names``: file_id, name."""
    rules = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("required")) for p, tails in REQUIRED for t in tails))
    wanted = names.select("file_id", F.col("name").alias("part"), F.explode(rules).alias("r")).where("part rlike r.pattern").select("file_id", "part", F.col("r.required").alias("required"))
    have = rels.select("file_id", "rels_part", F.col("type_tail").alias("required")).distinct()
    return wanted.withColumn("rels_part", rels_name(F.col("part"))).join(have, ["file_id", "rels_part", "required"], "left_anti").select("file_id", "part", "required")


def orphans(names: DataFrame, rels: DataFrame) -> DataFrame:
    """(file_id, part, kind): slides and notes that no internal relationship leads to."""
    kind = F.when(F.col("name").rlike(ORPHANS[0][1]), ORPHANS[0][0]).when(F.col("name").rlike(ORPHANS[1][1]), ORPHANS[1][0])
    found = names.select("file_id", F.col("name").alias("part"), kind.alias("kind")).where("kind is not null")
    reached = rels.where("not external").select("file_id", F.col("resolved").alias("part")).distinct()
    return found.join(reached, ["file_id", "part"], "left_anti").select("file_id", "part", "kind")


def pruned_relationships(rels: DataFrame, names: DataFrame) -> DataFrame:
    """``rels`` with keep: external, or leading to a part that is there."""
    there = names.select("file_id", F.col("name").alias("resolved")).distinct().withColumn("_there", F.lit(True))
    return rels.join(there, ["file_id", "resolved"], "left").withColumn("keep", F.col("external") | F.coalesce("_there", F.lit(False))).select(*rels.columns, "keep")


def shape_references(parts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(file_id, part, spid): shape ids that animations name but no shape of the part has."""
    return (inspections(parts) if seen is None else seen).select("file_id", "part", F.explode("found.lost_shapes").alias("spid"))


_MASTER_RELS = "^ppt/(?:slide|notes|handout)Masters/_rels/"


def _master(rels_part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(rels_part, r"/_rels/", "/"), r"\.rels$", "")


def missing_themes(names: DataFrame, rels: DataFrame) -> DataFrame:
    """(file_id, part, theme): masters whose theme is not there."""
    wanted = rels.where("not external and type_tail = 'theme'").where(F.col("rels_part").rlike(_MASTER_RELS))
    there = names.select("file_id", F.col("name").alias("resolved")).distinct()
    return wanted.join(there, ["file_id", "resolved"], "left_anti").select("file_id", _master(F.col("rels_part")).alias("part"), F.col("resolved").alias("theme"))


def missing_themes_of(names: Column, rels: Column) -> Column:
    """``missing_themes`` of one file's ``names`` and ``relationships_of``: an array of (part, theme)."""
    lost = lambda r: ~r["external"] & (r["type_tail"] == "theme") & r["rels_part"].rlike(_MASTER_RELS) & ~F.coalesce(F.array_contains(names, r["resolved"]), F.lit(False))
    return F.transform(F.filter(rels, lost), lambda r: F.named_struct(F.lit("part"), _master(r["rels_part"]), F.lit("theme"), r["resolved"]))


def media_mismatches(parts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(file_id, part, kind, spid): media that a timing tree plays from a shape without such a media element."""
    return (inspections(parts) if seen is None else seen).select("file_id", "part", F.explode("found.mismatches").alias("m")).select("file_id", "part", "m.kind", "m.spid")


def cleaned(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """``parts`` (file_id, name, payload, ...) without references to relationships that are gone, and ``removed``: rule, tag and ids of what went.

    ``rels``: file_id, rels_part, rid of relationships that stay. Only XML parts that name the relationship namespace go through
    the kernel; parts without a dangling reference, or not well-formed, keep their bytes. ``removed`` is null for the rest.
    """
    alive = rels.groupBy("file_id", F.col("rels_part").alias("_rels")).agg(F.collect_set("rid").alias("_alive"))  # relationships of one part
    touched = F.col("name").endswith(".xml") & (F.col("name") != "[Content_Types].xml") & F.contains(F.col("payload").cast("binary"), F.lit(xmltree.SPACES["r"].encode()))
    touched = F.coalesce(touched, F.lit(False))
    removed = "array<struct<rule:string,tag:string,ids:string>>"
    ready = parts.where(touched).withColumn("_rels", rels_name(F.col("name"))).join(alive, ["file_id", "_rels"], "left").select(*parts.columns, "_alive")
    at = parts.columns.index("payload")
    kind = pa.list_(pa.struct([("rule", pa.string()), ("tag", pa.string()), ("ids", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, said = [], []
            for data, ids in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                try:
                    new, gone = xmltree.once(xmltree.cleaned, data.as_py(), frozenset(ids.as_py() or ()))
                except ExpatError:
                    new, gone = data.as_py(), None
                out.append(new)
                said.append(gone)
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, kind)], names=[*batch.schema.names[:-1], "removed"])

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'payload' else f.dataType.simpleString()}" for f in parts.schema)
    rest = parts.where(~touched).withColumn("payload", F.col("payload").cast("binary")).withColumn("removed", F.lit(None).cast(removed))
    return ready.withColumn("payload", F.col("payload").cast("binary")).mapInArrow(run, f"{schema}, removed {removed}").unionByName(rest)


def summary(rows: DataFrame) -> DataFrame:
    """(file_id, n, n_parts, parts): how many findings a file has, and the parts that have some, in order."""
    return rows.groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("n_parts"), F.array_sort(F.collect_set("part")).alias("parts"))  # parts of one file
