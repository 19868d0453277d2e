"""Incremental scans: a file is looked at again only when its size or time has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_stamps(stamps: DataFrame, key: str, seq: str, stamp: list[str]) -> DataFrame:
    """The last row of each key and whether its stamp differs from the one before: key, stamp..., n_seen, changed."""
    own = W.partitionBy(key)
    ordered = own.orderBy(seq)
    same = F.lit(True)
    for c in stamp:
        same = same & F.lag(c).over(ordered).eqNullSafe(F.col(c))
    ranked = stamps.withColumns({"changed": ~same | F.lag(seq).over(ordered).isNull(), "n_seen": F.count("*").over(own), "_r": F.row_number().over(own.orderBy(F.desc(seq)))})
    return ranked.where("_r = 1").select(key, seq, *stamp, "n_seen", "changed")


def stale(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files without a known result for their (path, size, mtime_ns)."""
    return listed.join(known.select("path", "size", "mtime_ns").distinct(), ["path", "size", "mtime_ns"], "left_anti")


def new_files(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """A stream of (path, size, mtime_ns, ...) with each stamp once; state goes after ``watermark`` of column seen_at, if given."""
    if watermark is None:
        return stream.dropDuplicates(["path", "size", "mtime_ns"])
    return stream.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["path", "size", "mtime_ns"])


def diagnose_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.ppt[xm]", files_per_trigger: int = 1000):
    """A running query that appends a verdict for each new file below ``folder`` to Parquet in ``out``; restarts go on where they stopped."""
    from shardwright.operators.classify import diagnose

    found = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
        .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    )
    judged = diagnose(found.select("path", F.col("modificationTime").alias("mtime"), "content")).select("path", "mtime", "size", "verdict", "salvage", "evidence")
    return judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def verdict_totals(stream: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Verdicts per window of mtime, for append mode."""
    return stream.withWatermark("mtime", watermark).groupBy(F.window("mtime", window), "verdict").agg(F.count("*").alias("n"))
