"""Damage verdicts of packages: facts from the bytes, then one decision expression.

``read_packages`` crosses to Python once for each file and returns the file's
structure and both lists of entries in its row. Everything after it is built-in
expressions over that row, so classification needs no shuffle however many
files there are; ``entry_rows`` explodes the entries where relations are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.functions import zipbytes
from shardwright.functions.names import CORE_PARTS, categorize, head_kind, slide_number
from shardwright.session import file_batches

# Thresholds of the decision.
MIX_ENTRIES, HEAD_ZEROS, ALL_ZERO, TAIL_JUNK, SCATTER_ENTRIES, SCATTER_SHARE = 5, 4096, 0.99, 65557, 20, 0.10
#: Files whose facts go on together, and their bytes.
ROWS, ROWS_BYTES = 256, 4 << 20
# Verdicts by the census that can be trusted for them.
LFH_VERDICTS = ["version_mix", "tail_truncated", "tail_foreign_data"]

ENTRY = "struct<name:string,header_offset:bigint,file_size:bigint,ok:boolean,error:string,crc:bigint,comp_size:bigint>"
FACTS = (
    "zero_runs array<struct<start:bigint,end:bigint>>, lfh_offsets array<bigint>, cd_sig_count bigint,"
    "eocd struct<offset:bigint,total_entries:bigint,cd_offset:bigint,cd_size:bigint,is_consistent:boolean,comment_length:bigint>,"
    f"cd array<{ENTRY}>, lfh array<{ENTRY}>, read_error string"
)


def read_packages(files: DataFrame, content_col: str = "content", keep: bool = False) -> DataFrame:
    """``files`` with size, head_kind, zero_runs, lfh_offsets, cd_sig_count, eocd, cd (null: no usable index), lfh and read_error.

    The content column goes, unless ``keep``: then the bytes stay in their row, so nobody need join them back. Null content gives null facts and a read_error; a file that
    can't be read never stops the others.
    """
    rest = [c for c in files.columns if c != content_col]
    base = files.select(*rest, F.octet_length(content_col).cast("long").alias("size"), head_kind(F.col(content_col)).alias("head_kind"), F.col(content_col).alias("_content"))
    base = base.withColumnRenamed("_content", content_col) if keep else base
    schema = base.drop("_content").schema
    width, at = len(schema), len(base.columns) - 1
    facts = base.sparkSession.createDataFrame([], FACTS).schema
    arrow = pa.schema([_arrow(f) for f in facts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, size = [], 0, 0

            def made(to: int) -> pa.RecordBatch:
                facts = pa.RecordBatch.from_pylist(rows, schema=arrow)
                return pa.RecordBatch.from_arrays([*(c.slice(first, to - first) for c in batch.columns[:width]), *facts.columns], names=[*batch.schema.names[:width], *arrow.names])

            for i, content in enumerate(batch.column(at)):
                data = content.as_py()
                row: dict = dict.fromkeys(arrow.names)
                try:
                    if data is None:
                        raise ValueError("no content")
                    row |= zipbytes.structure(data) | {"cd": zipbytes.index_entries(data), "lfh": zipbytes.header_entries(data)}
                except Exception as e:
                    row["read_error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
                size += len(data or b"")
                if len(rows) == ROWS or size > ROWS_BYTES:  # facts of files, never their bytes
                    yield made(i + 1)
                    rows, first, size = [], i + 1, 0
            if rows:
                yield made(batch.num_rows)

    for field in [*schema.fields, *facts.fields]:
        field.nullable = True
        schema = schema if field.name in schema.names else schema.add(field)
    return file_batches(base).mapInArrow(run, schema)


def _arrow(field) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType))


def _ok(entries: str) -> Column:
    return F.filter(entries, lambda e: e["ok"])


def _count(entries: Column) -> Column:
    return F.size(entries)


def zero_ratio() -> Column:
    """The share of the file inside zero runs; 0 for an empty file."""
    total = F.aggregate("zero_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return F.when(F.col("size") > 0, total / F.col("size")).otherwise(0.0)


def features(packages: DataFrame) -> DataFrame:
    """The figures that the decision looks at."""
    offsets = lambda e: F.transform(e, lambda x: x["header_offset"])
    names = lambda e: F.transform(e, lambda x: x["name"])
    spots = lambda e: F.transform(e, lambda x: F.concat_ws("|", x["header_offset"].cast("string"), x["name"]))
    cd = F.coalesce("cd", F.array().cast(f"array<{ENTRY}>"))
    lfh_ok = F.filter("lfh", lambda e: e["ok"])
    first_zero = F.get("zero_runs", F.lit(0))
    base = packages.withColumns({
        "zero_ratio": zero_ratio(),
        "has_cd": F.col("cd").isNotNull(),
        "cd_total": F.size(cd),
        "cd_ok": F.size(F.filter(cd, lambda e: e["ok"])),
        "lfh_ok": F.size(lfh_ok),
        "core_ok": F.size(F.array_except(F.array(*(F.lit(n) for n in CORE_PARTS)), names(F.filter(cd, lambda e: e["ok"])))) == 0,
        "unlisted": F.size(F.array_except(offsets(lfh_ok), offsets(cd))),
        "foreign_names": F.array_except(names(lfh_ok), names(cd)),
        "_matched": F.array_intersect(spots(lfh_ok), spots(cd)),
        "_zero_head": F.when(first_zero["start"] == 0, first_zero["end"]),
    })
    first_ok = F.array_min(F.transform("_matched", lambda x: F.substring_index(x, "|", 1).cast("long")))
    before = lambda limit: F.filter(cd, lambda e: e["header_offset"] < limit)
    lost_before = lambda limit: (F.size(before(limit)) > 0) & ~F.exists(before(limit), lambda e: e["ok"])
    return base.withColumns({
        "head_zeroed": F.coalesce((F.col("_zero_head") >= HEAD_ZEROS) & lost_before(F.col("_zero_head")), F.lit(False)),
        "head_replaced": F.coalesce(lost_before(first_ok) & ~F.exists(cd, lambda e: ~e["ok"] & (e["header_offset"] >= first_ok)), F.lit(False)),
    }).drop("_matched", "_zero_head")


def verdict() -> Column:
    """The first rule that fits. Null facts give a null verdict."""
    end, zeroed = F.col("eocd"), F.col("zero_ratio") >= ALL_ZERO
    sound = F.coalesce(end["is_consistent"], F.lit(False))
    odd_head = F.col("head_kind").isin("other", "zeros")
    behind = F.col("size") - (end["offset"] + 22 + end["comment_length"])
    no_signs = (F.size("lfh_offsets") == 0) & (F.col("cd_sig_count") == 0) & end.isNull()
    mixed = (
        F.when(F.col("unlisted") >= MIX_ENTRIES, "version_mix")
        .when(F.col("head_zeroed"), "head_zero_fill")
        .when(odd_head & F.col("head_replaced"), "head_foreign_data")
        .when((F.col("head_kind") == "zip") & sound & (F.col("cd_ok") > 0), "interior_damage")
        .when(odd_head & (F.size("foreign_names") > 0), "foreign_zip_overwrite")
        .when(sound & (F.col("cd_total") >= SCATTER_ENTRIES) & (F.size("lfh_offsets") / F.col("cd_total") < SCATTER_SHARE), "scattered_overwrite")
        .otherwise("other_corrupt")
    )
    return (
        F.when(F.col("read_error").isNotNull(), None)
        .when(F.col("size") == 0, "empty_file")
        .when(no_signs, F.when((F.col("head_kind") != "cfb") & zeroed, "full_zero_fill").otherwise("not_a_zip"))
        .when(end.isNull(), F.when((F.col("head_kind") == "zip") & (F.size("lfh_offsets") > 0), "tail_truncated").when(F.col("head_kind") == "cfb", "not_a_zip").when(zeroed, "full_zero_fill").otherwise("other_corrupt"))
        .when(~F.col("has_cd"), F.when(zeroed & (F.col("lfh_ok") == 0), "full_zero_fill").when(sound & (behind > TAIL_JUNK) & (F.col("lfh_ok") > 0), "tail_foreign_data").otherwise("other_corrupt"))
        .when((F.col("cd_total") > 0) & (F.col("cd_ok") == F.col("cd_total")), F.when(F.col("core_ok"), "normal").otherwise("other_corrupt"))
        .otherwise(mixed)
    )


def salvage_summary() -> Column:
    """Counts of the census that the verdict trusts; null without entries."""
    source = F.when(F.col("verdict").isin(LFH_VERDICTS), "lfh").when(F.col("has_cd"), "cd").otherwise("lfh")
    entries = F.when(source == "cd", F.col("cd")).otherwise(F.col("lfh"))
    slides = F.filter(entries, lambda e: slide_number(e["name"]).isNotNull())
    n = lambda e: F.size(e).cast("long")
    ok = lambda e: F.filter(e, lambda x: x["ok"])
    summary = F.struct(n(ok(entries)).alias("entries_ok"), n(entries).alias("entries_total"), n(ok(slides)).alias("slides_ok"), n(slides).alias("slides_total"), source.alias("source"))
    return F.when(F.size(entries) > 0, summary)


def evidence() -> Column:
    """Short notes on what the decision saw."""
    notes = [
        F.format_string("size %d, head %s", "size", "head_kind"),
        F.when(F.size("zero_runs") > 0, F.format_string("%d zero runs, %.4f of the file", F.size("zero_runs"), F.col("zero_ratio"))),
        F.when(F.col("eocd").isNotNull(), F.format_string("index end at %d", F.col("eocd.offset"))).otherwise("no index end"),
        F.when(F.col("has_cd"), F.format_string("index reads %d of %d entries", "cd_ok", "cd_total")),
        F.when(F.col("lfh_ok") > 0, F.format_string("headers read %d entries", "lfh_ok")),
        F.when(F.size("foreign_names") > 0, F.concat(F.lit("unlisted: "), F.array_join(F.slice(F.array_sort("foreign_names"), 1, 5), ", "), F.when(F.size("foreign_names") > 5, F.format_string(" and %d more", F.size("foreign_names") - 5)).otherwise(""))),
    ]
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def diagnose(files: DataFrame, content_col: str = "content", keep: bool = False) -> DataFrame:
    """One row per file: its columns, the facts, verdict, evidence, salvage, and corrupted (null verdicts are errors, not corrupted)."""
    judged = features(read_packages(files, content_col, keep)).withColumn("verdict", verdict())
    return judged.withColumns({"salvage": salvage_summary(), "evidence": F.when(F.col("read_error").isNull(), evidence()), "corrupted": F.coalesce(F.col("verdict") != "normal", F.lit(False))})


def is_unknown_pattern() -> Column:
    """Files that a fingerprint is wanted for."""
    return (F.col("verdict") == "other_corrupt") | ((F.col("verdict") == "not_a_zip") & ~F.col("head_kind").eqNullSafe("cfb"))


def entry_rows(diagnosed: DataFrame, id_col: str) -> DataFrame:
    """(id_col, method, entry_seq, name, category, ...) of both censuses."""
    one = lambda method: diagnosed.select(id_col, F.lit(method).alias("method"), F.posexplode(method).alias("entry_seq", "e"))
    return one("cd").unionByName(one("lfh")).select(id_col, "method", "entry_seq", categorize(F.col("e.name")).alias("category"), "e.*")


def has_core(entries: DataFrame) -> DataFrame:
    """(file_id, core_ok): whether a file's readable entries (file_id, name, ok) hold every part that a package must have."""
    core = F.col("ok") & F.col("name").isin(CORE_PARTS)
    return entries.groupBy("file_id").agg((F.count_distinct(F.when(core, F.col("name"))) == len(CORE_PARTS)).alias("core_ok"))


def exit_code(diagnosed: DataFrame) -> DataFrame:
    """One row: 2 if a file could not be read, else 1 if one is not normal, else 0."""
    return diagnosed.agg(F.when(F.bool_or(F.col("verdict").isNull()), 2).when(F.bool_or("corrupted"), 1).otherwise(0).alias("exit_code"))
