"""Which entries to take from which census or copy, and the byte ranges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardwright.session import dealt

# The censuses that a verdict lets entries be taken from.
POLICY = {
    "tail_truncated": "lfh", "version_mix": "lfh", "tail_foreign_data": "lfh",
    "head_zero_fill": "cd", "head_foreign_data": "cd", "interior_damage": "cd",
    "foreign_zip_overwrite": "cd+matched", "scattered_overwrite": "cd+matched", "other_corrupt": "cd+lfh",
}


def matched_headers(entries: DataFrame) -> DataFrame:
    """Readable header entries that the index lists at the same place by the same name."""
    cd = entries.where("method = 'cd'").select("file_id", "name", "header_offset").distinct()
    return entries.where("method = 'lfh' and ok").join(cd, ["file_id", "name", "header_offset"], "left_semi")


def unlisted_headers(entries: DataFrame) -> DataFrame:
    """Readable header entries at places that the index doesn't list."""
    cd = entries.where("method = 'cd'").select("file_id", "header_offset").distinct()
    return entries.where("method = 'lfh' and ok").join(cd, ["file_id", "header_offset"], "left_anti")


def foreign_fragments(entries: DataFrame) -> DataFrame:
    """Readable header entries whose names the index doesn't list."""
    cd = entries.where("method = 'cd'").select("file_id", "name").distinct()
    return entries.where("method = 'lfh' and ok").join(cd, ["file_id", "name"], "left_anti")


def all_entries(entries: DataFrame) -> DataFrame:
    """The index's entries and the header entries at other places."""
    cd = entries.where("method = 'cd'")
    rest = entries.where("method = 'lfh'").join(cd.select("file_id", "header_offset").distinct(), ["file_id", "header_offset"], "left_anti")
    return cd.unionByName(rest.select(*cd.columns))


def deduplicated(entries: DataFrame) -> DataFrame:
    """One entry per file and name: the index's before a header's, then the last in the file; with n_same rows of that name."""
    own = W.partitionBy("file_id", "name")
    ranked = entries.withColumns({"_r": F.row_number().over(own.orderBy(F.col("method") != "cd", F.desc("header_offset"))), "n_same": F.count("*").over(own)})
    return ranked.where("_r = 1").drop("_r")


def select_salvageable(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The entries that each file's verdict lets be taken, one per name. ``verdicts``: file_id, verdict."""
    policy = F.create_map(*(F.lit(x) for pair in POLICY.items() for x in pair))
    allowed = verdicts.select("file_id", F.try_element_at(policy, F.col("verdict")).alias("policy")).where("policy is not null")
    readable = entries.where("ok")
    cd = readable.where("method = 'cd'").join(allowed.where("policy <> 'lfh'"), "file_id")
    lfh = readable.where("method = 'lfh'").join(allowed.where("policy in ('lfh', 'cd+lfh')"), "file_id")
    matched = matched_headers(entries).select(*entries.columns).join(allowed.where("policy = 'cd+matched'"), "file_id")
    return deduplicated(cd.unionByName(lfh).unionByName(matched))


def salvageable(diagnosed: DataFrame, name: str = "salvageable") -> DataFrame:
    """``diagnosed`` with an array of (name, header_offset): what ``select_salvageable`` takes, from the row's own lists, so no row moves."""
    none = F.array().cast("array<struct<name:string,late:int,back:bigint>>")
    one = lambda e, late: F.struct(e["name"].alias("name"), F.lit(late).alias("late"), (-e["header_offset"]).alias("back"))
    pick = lambda method, late: F.coalesce(F.transform(F.filter(method, lambda e: e["ok"]), lambda e: one(e, late)), none)
    spots = F.coalesce(F.transform("cd", lambda e: one(e, 1)), none)
    policy = F.try_element_at(F.create_map(*(F.lit(x) for pair in POLICY.items() for x in pair)), F.col("verdict"))
    cd = F.when(policy != "lfh", pick("cd", 0)).otherwise(none)
    lfh = F.when(policy.isin("lfh", "cd+lfh"), pick("lfh", 1)).when(policy == "cd+matched", F.array_intersect(pick("lfh", 1), spots)).otherwise(none)
    pool = diagnosed.withColumn("_pool", F.array_sort(F.concat(cd, lfh)))  # by name, the index's first, then the last in the file
    first = F.filter("_pool", lambda e, i: (i == 0) | (e["name"] != F.get("_pool", i - 1)["name"]))
    return pool.withColumn(name, F.transform(first, lambda e: F.struct(e["name"].alias("name"), (-e["back"]).alias("header_offset")))).drop("_pool")


def entry_intervals(entries: DataFrame, ends: DataFrame) -> DataFrame:
    """(file_id, name, from_byte, to_byte, layout_ok): each entry up to the next or to the index; one bad interval spoils its file's layout.

    ``ends``: file_id, cd_start.
    """
    own = W.partitionBy("file_id")
    n = dealt(entries.count(), entries.sparkSession.sparkContext.defaultParallelism)
    spans = entries.repartition(n, "file_id").join(ends.repartition(n, "file_id"), "file_id").withColumn("to_byte", F.coalesce(F.lead("header_offset").over(own.orderBy("header_offset", "name")), F.col("cd_start"))).withColumn("from_byte", F.col("header_offset"))
    fine = (F.col("from_byte") >= 0) & (F.col("from_byte") < F.col("cd_start")) & (F.col("to_byte") > F.col("from_byte")) & (F.col("to_byte") <= F.col("cd_start"))
    return spans.withColumn("layout_ok", F.bool_and(fine).over(own)).select("file_id", "name", "from_byte", "to_byte", "layout_ok")


def gaps(intervals: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_id, gap_from, gap_to): ranges of [0, size) that no interval covers. ``sizes``: file_id, size."""
    stop = sizes.select("file_id", F.col("size").alias("from_byte"), F.col("size").alias("to_byte"))
    every = intervals.select("file_id", "from_byte", "to_byte").union(stop)
    before = W.partitionBy("file_id").orderBy("from_byte", "to_byte").rowsBetween(W.unboundedPreceding, -1)
    covered = F.coalesce(F.max("to_byte").over(before), F.lit(0))
    return every.withColumn("gap_from", covered).where("from_byte > gap_from").select("file_id", "gap_from", F.col("from_byte").alias("gap_to"))


def first_valid_copy(candidates: DataFrame) -> DataFrame:
    """For each entry of a group the first copy that reads: ``candidates`` has group_id, name, copy_rank, entry_seq, ok."""
    order = W.partitionBy("group_id", "name").orderBy("copy_rank", "entry_seq")
    return candidates.where("ok").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def degraded_union(candidates: DataFrame, donors: DataFrame) -> DataFrame:
    """First valid copies, and donors' entries for names that no copy has. ``donors`` has the columns of ``candidates``."""
    kept = first_valid_copy(candidates)
    fill = first_valid_copy(donors).join(kept.select("group_id", "name"), ["group_id", "name"], "left_anti")
    return kept.withColumn("source", F.lit("copy")).unionByName(fill.withColumn("source", F.lit("donor")))


def donors_by_content(missing: DataFrame, donors: DataFrame) -> DataFrame:
    """(target, name, donor, donor_name): missing entries found elsewhere by checksum and size.

    ``missing``: target, name, crc, file_size; ``donors``: donor, donor_rank, name, crc, file_size, valid.
    A donor offers the equally named entry, else the first by name; if what it offers does not
    verify, the next donor is asked.

    What a content's donors offer is settled before the join, so a missing entry meets one row however many donors hold a
    content; only where the first donor has an equally named entry beside the one it would offer, or a target misses several contents
    of one name, are all of that content's donors asked.
    """
    d = donors.select("donor", "donor_rank", F.col("name").alias("donor_name"), "crc", "file_size", "valid")
    content, rank = ["crc", "file_size"], F.struct("donor_rank", "donor")
    first = d.groupBy(*content, "donor").agg(F.min(F.struct("donor_name", "donor_rank", "valid")).alias("o")).where("o.valid")
    best = first.groupBy(*content).agg(F.min(F.struct("o.donor_rank", "donor", "o.donor_name")).alias("b"))
    named = d.groupBy(*content, F.col("donor_name").alias("name")).agg(F.min(F.when(F.col("valid"), rank)).alias("s"))
    other = d.join(best, content).where("donor = b.donor and donor_name <> b.donor_name").select(*content, F.col("donor_name").alias("name"), F.lit(True).alias("other")).distinct()
    several = missing.groupBy("target", "name").agg(F.count("*").alias("several")).where("several > 1")
    met = missing.select("target", "name", *content).join(several, ["target", "name"], "left").join(best, content, "left").join(named, [*content, "name"], "left").join(other, [*content, "name"], "left")
    own = F.col("s").isNotNull() & (F.col("b").isNull() | (F.col("s") <= F.struct("b.donor_rank", "b.donor")))
    plain = met.where("other is null and several is null and (b is not null or s is not null)").select("target", "name", F.when(own, F.col("s.donor")).otherwise(F.col("b.donor")).alias("donor"), F.when(own, F.col("name")).otherwise(F.col("b.donor_name")).alias("donor_name"))
    asked = met.where("other or several is not null").select("target", "name", *content).join(d, content)
    offer = W.partitionBy("target", "name", "donor").orderBy(F.col("name") != F.col("donor_name"), "donor_name")
    offered = asked.withColumn("_o", F.row_number().over(offer)).where("_o = 1 and valid")
    rest = offered.groupBy("target", "name").agg(F.min(F.struct("donor_rank", "donor", "donor_name")).alias("f")).select("target", "name", "f.donor", "f.donor_name")
    return plain.unionByName(rest)


def donors_by_name(missing: DataFrame, donors: DataFrame) -> DataFrame:
    """(target, name, donor): missing entries by name alone, from the first donor that has a readable one; it is the same for all targets, so it is found before the join."""
    best = donors.where("valid").groupBy("name").agg(F.min(F.struct("donor_rank", "donor")).alias("b"))
    return missing.select("target", "name").join(best, "name").select("target", "name", "b.donor")


def rekeyed(donor_entries: DataFrame, recovered: DataFrame, reference: DataFrame) -> DataFrame:
    """(donor, name, new_name, origin) for every entry of a donor whose structure is borrowed.

    By checksum and size an entry is the target's own (recovered), one that the
    reference lists under some name (listed), or the donor's alone (donor).
    ``donor_entries``: donor, name, crc, file_size; ``recovered`` and ``reference``: target's name, crc, file_size.
    """
    own = recovered.groupBy("crc", "file_size").agg(F.min("name").alias("own_name"))
    listed = reference.groupBy("crc", "file_size").agg(F.min("name").alias("ref_name"))
    met = donor_entries.join(own, ["crc", "file_size"], "left").join(listed, ["crc", "file_size"], "left")
    origin = F.when(F.col("own_name").isNotNull(), "recovered").when(F.col("ref_name").isNotNull(), "listed").otherwise("donor")
    return met.select("donor", "name", F.coalesce("own_name", "ref_name", "name").alias("new_name"), origin.alias("origin"))


def unique_names(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """``rows`` with unique_name: repeats of a name in a group get a number before the suffix."""
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(group, name).orderBy(order)))
    stem, end = F.regexp_replace(name, r"(?<=.)\.[^./]+$", ""), F.regexp_extract(name, r"^.+?(\.[^./]+)$", 1)
    return numbered.withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.format_string(" (%d)", "_n"), end))).drop("_n")
