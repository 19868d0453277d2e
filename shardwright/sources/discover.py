"""Files below given roots, without opening them: a Python data source and its classification.

Spark's own file listing leaves out hidden names, files in hidden folders and
empty files, all of which count here. A partition lists one root, so roots are
listed in parallel; contents are read later, by ``with_content``, over partitions dealt by path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shardwright.session import tasks
from shardwright.sources.retry import retrying

from shardwright.functions.names import basename, bucket, is_download, is_placeholder

LISTING = "root string, root_no int, walk_seq bigint, path string, size bigint, mtime_ns bigint, st_flags bigint, attributes bigint, error string"


class Listing(DataSource):
    """``spark.read.format("package_files").option("roots", "a\\nb")``; option follow_symlinks: true or false."""

    @classmethod
    def name(cls) -> str:
        return "package_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> "ListingReader":
        return ListingReader(self.options["roots"].split("\n"), self.options.get("follow_symlinks", "false") == "true")


class ListingReader(DataSourceReader):
    def __init__(self, roots: list[str], follow: bool):
        self.roots, self.follow = roots, follow

    def partitions(self) -> list[InputPartition]:
        """One partition a root; one for all where links are followed, as folders seen before are skipped across roots."""
        each = list(enumerate(self.roots))
        return [InputPartition(each)] if self.follow else [InputPartition([x]) for x in each]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        seen: set[tuple[int, int]] = set()
        for number, root in partition.value:
            for seq, (path, stat, error) in enumerate(walked(root, self.follow, seen)):
                facts = (stat.st_size, stat.st_mtime_ns, getattr(stat, "st_flags", 0), getattr(stat, "st_file_attributes", 0)) if stat else (None,) * 4
                yield (root, number, seq, path, *facts, error)


def walked(root: str, follow: bool, seen: set[tuple[int, int]]) -> Iterator[tuple[str, os.stat_result | None, str | None]]:
    """(path, stat, error) in order: a folder's files by name, then its folders. Errors are rows."""
    try:
        stat = os.stat(root)
    except OSError as e:
        yield root, None, type(e).__name__
        return
    if os.path.isfile(root):
        yield root, stat, None
        return
    if not os.path.isdir(root):
        return
    if follow:
        if (stat.st_dev, stat.st_ino) in seen:
            return
        seen.add((stat.st_dev, stat.st_ino))
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError as e:
        yield root, None, type(e).__name__
        return
    folders = []
    for e in entries:
        try:
            if e.is_symlink() and not follow:
                continue
            if e.is_dir():
                folders.append(e.path)
            elif e.is_file():
                yield e.path, e.stat(), None
        except OSError as error:
            yield e.path, None, type(error).__name__
    for folder in folders:
        yield from walked(folder, follow, seen)


def discover(spark: SparkSession, roots: list[str], *, follow_symlinks: bool = False, exclude: tuple[str, ...] = (), **rules) -> DataFrame:
    """(root, root_no, walk_seq, path, size, mtime_ns, bucket, is_download, error): every file that counts; ``rules`` go to ``names.bucket``.

    ``exclude``: paths that drop out with all below them.
    """
    spark.dataSource.register(Listing)
    listed = spark.read.format("package_files").option("roots", "\n".join(roots)).option("follow_symlinks", str(follow_symlinks).lower()).load()
    cloud = is_placeholder(F.col("st_flags"), F.col("attributes"))
    placed = listed.withColumn("bucket", F.when(F.col("error").isNotNull(), "errors").otherwise(bucket(basename(F.col("path")), F.col("size"), cloud, **rules))).withColumn("is_download", is_download(F.col("bucket"), cloud))
    for path in exclude:
        placed = placed.where((F.col("path") != path) & ~F.col("path").startswith(path.rstrip("/") + "/"))
    return placed.where("bucket is not null").drop("st_flags", "attributes")


def with_content(listed: DataFrame) -> DataFrame:
    """``listed`` with content; a file that can't be read, after the tries of ``retry``, has null and an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                content, error = None, row.column("error")[0].as_py()
                try:
                    with retrying(lambda: open(row.column("path")[0].as_py(), "rb"))[0] as f:
                        content = f.read()
                except OSError as e:
                    error = type(e).__name__
                at = batch.schema.get_field_index("error")
                columns = [*row.columns[:at], pa.array([error], pa.string()), *row.columns[at + 1 :], pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "content"])

    schema = listed.withColumn("content", F.lit(None).cast("binary")).schema
    for field in schema:
        field.nullable = True
    return listed.repartition(tasks(listed.sparkSession), "path").mapInArrow(run, schema)
