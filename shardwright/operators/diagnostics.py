"""Byte profiles, runs and fingerprints of files with unknown damage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardwright.functions.names import block_class
from shardwright.session import placed

PROFILE_BLOCK, FINGERPRINTS = 65536, 20


def runs(rows: DataFrame, key: str, order: list[str], label: str, length: str, value: str) -> DataFrame:
    """Neighbouring rows of one label become one: (key, run_no, label, rows, length, mean); mean is weighted by length."""
    own = W.partitionBy(key).orderBy(*order)
    starts = F.coalesce((~F.lag(label).over(own).eqNullSafe(F.col(label))).cast("long"), F.lit(1))
    first = F.row_number().over(own) == 1
    numbered = rows.withColumn("_s", F.when(first, 1).otherwise(starts).cast("long")).withColumn("run_no", F.sum("_s").over(own.rowsBetween(W.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "run_no", label).agg(F.count("*").alias("n_rows"), F.sum(length).alias("length"), F.sum(F.col(value) * F.col(length)).alias("_w"))
    return out.select(key, "run_no", label, "n_rows", "length", (F.col("_w") / F.col("length")).alias("mean"))


def entropy_of_counts(counts: DataFrame, key: list[str]) -> DataFrame:
    """Bits a symbol from (key..., symbol, n)."""
    total = counts.groupBy(*key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(*key, "total", (F.log2("total") - F.col("s") / F.col("total")).alias("entropy"))


def block_profile(files: DataFrame, id_col: str = "file_id", content_col: str = "content", block: int = PROFILE_BLOCK) -> DataFrame:
    """(id_col, block_no, length, class, entropy) of every block of every file; empty and null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printable = np.zeros(256, bool)
        printable[[9, 10, 13, *range(0x20, 0x7F)]] = True
        for batch in batches:
            for i, content in enumerate(batch.column(1)):
                data = np.frombuffer(content.as_py() or b"", np.uint8)
                rows = []
                for no, at in enumerate(range(0, len(data), block)):
                    counts = np.bincount(data[at : at + block], minlength=256)
                    p = counts[counts > 0] / counts.sum()
                    rows.append({"block_no": no, "length": int(counts.sum()), "zeros": int(counts[0]), "printable": int(counts[printable].sum()), "entropy": float(-(p * np.log2(p)).sum()) + 0.0})
                if rows:
                    made = pa.RecordBatch.from_pylist(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), batch.schema.field(0).type), *made.columns], names=[id_col, *made.schema.names])

    kind = files.schema[id_col].dataType.simpleString()
    made = files.select(id_col, F.col(content_col).cast("binary")).mapInArrow(run, f"{id_col} {kind}, block_no long, length long, zeros long, printable long, entropy double")
    return made.select(id_col, "block_no", "length", block_class(F.col("zeros"), F.col("printable"), F.col("length"), F.col("entropy")).alias("class"), "entropy")


def chunk_profile(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """Runs of equal block class: (id_col, run_no, class, n_rows, length, mean)."""
    return runs(block_profile(files, id_col, content_col), id_col, ["block_no"], "class", "length", "entropy")


def fingerprints(diagnosed: DataFrame, order: str, limit: int = FINGERPRINTS) -> DataFrame:
    """(order, fingerprint): a JSON text for the first ``limit`` files of unknown damage. ``diagnosed`` comes from ``classify.diagnose``."""
    from shardwright.operators.classify import is_unknown_pattern

    facts = F.struct(F.lit(1).alias("schema_version"), F.lit("fingerprint").alias("kind"), "verdict", "size", "head_kind", "zero_ratio", "zero_runs", "cd_sig_count", "eocd", "cd_total", "cd_ok", "lfh_ok", "foreign_names")
    return diagnosed.where(is_unknown_pattern()).orderBy(order).limit(limit).select(order, F.to_json(facts).alias("fingerprint"))


def layouts(profile: DataFrame, id_col: str = "file_id") -> DataFrame:
    """(id_col, layout): the classes of a file's runs in order."""
    ordered = F.array_sort(F.collect_list(F.struct("run_no", "class")))
    return profile.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda r: r["class"]), ">").alias("layout"))


def roll_up(rows: DataFrame, column: str, seq: str) -> DataFrame:
    """(column, n, place): how often each value occurs; the most frequent first, then the first seen."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
    return placed(counted, [F.desc("n"), F.col("_first")], "place").drop("_first")
