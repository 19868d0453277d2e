"""Shared folders and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it names none, a folder below the warehouse, which a cluster shares; a temporary one only if
    driver and tasks are one local process, as in tests.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        if not named and sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="shardwright-")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return named or sc.getCheckpointDir()


def tasks(spark: SparkSession) -> int:
    """How many tasks to deal rows to that are small but cost much, so that adaptive execution doesn't join their partitions by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of small fields that a task sorts, about 50 MB; up to ``PLAIN_PARTITIONS`` partitions those that deal them out need no memory for it (Spark's bypassMergeThreshold), so that beyond them tasks get more, up to ``MOST_ROWS``.
TASK_ROWS, MOST_ROWS, PLAIN_PARTITIONS = 1 << 18, 1 << 22, 200


def dealt(rows: int, parallel: int) -> int:
    """In how many partitions ``rows`` are sorted, so that what a task holds doesn't grow with them. Adaptive execution leaves a named number alone, where it would join partitions by their packed bytes."""
    plain = min(PLAIN_PARTITIONS, -(-rows // TASK_ROWS))
    return max(1, parallel, plain, -(-rows // MOST_ROWS))


#: Bytes of a batch of whole files on their way to Python.
FILE_BATCH = 4 << 20


def file_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows hold files, in a session that hands Python at most ``FILE_BATCH`` bytes at once (or one file): workers of a chain each hold a batch and what they make of it. The setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key)
    if int(now.rstrip("bB")) > FILE_BATCH if now.rstrip("bB").isdigit() else True:
        df.sparkSession.conf.set(key, str(FILE_BATCH))
    return df


def placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 1, in ``order``. Ranges are sorted apart and begin where those before them end; their counts are a row a task."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    dealt = df.repartitionByRange(*order).withColumn("_place_range", F.spark_partition_id())
    held = stored(dealt, "ranges")
    counts = held.groupBy("_place_range").agg(F.count("*").alias("_place_n"))
    first = counts.select("_place_range", F.coalesce(F.sum("_place_n").over(W.orderBy("_place_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_place_first"))
    inside = F.row_number().over(W.partitionBy("_place_range").orderBy(*order))
    return held.withColumn("_place_inside", inside).join(F.broadcast(first), "_place_range").withColumn(name, F.col("_place_first") + F.col("_place_inside")).drop("_place_range", "_place_inside", "_place_first")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; later reads start there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``cut`` by a Parquet table in the same folder: smaller than a checkpoint where rows are many."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
