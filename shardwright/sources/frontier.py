"""A walk of folders level by level: folders are rows, dealt to tasks, and each level is one job.

A level lists the folders of the frontier; the folders found there, less those whose (device, inode)
was seen, are the next one. So a wide tree is listed by all tasks, whatever its roots, and links that lead
back end the walk where they close. Of several ways to one folder the one with the fewest steps
counts, then the first by name. Links to folders are followed only on request.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.session import stored, tasks

#: Columns of a listing: walk_key sorts a folder's files, by name, before its folders.
ROW = "root_no int, kind string, path string, walk_key string, size bigint, mtime_ns bigint, st_flags bigint, attributes bigint, device bigint, inode bigint, error string"
_ARROW = pa.schema([("root_no", pa.int32()), ("kind", pa.string()), ("path", pa.string()), ("walk_key", pa.string()), *((c, pa.int64()) for c in ("size", "mtime_ns", "st_flags", "attributes", "device", "inode")), ("error", pa.string())])
BATCH = 4096


def _row(root_no: int, kind: str, path: str, key: str, stat: os.stat_result | None = None, error: str | None = None) -> dict:
    row = {"root_no": root_no, "kind": kind, "path": path, "walk_key": key, "error": error}
    if stat is not None:
        inode = stat.st_ino - (1 << 64) if stat.st_ino >= 1 << 63 else stat.st_ino
        row |= {"size": stat.st_size, "mtime_ns": stat.st_mtime_ns, "st_flags": getattr(stat, "st_flags", 0), "attributes": getattr(stat, "st_file_attributes", 0), "device": stat.st_dev, "inode": inode}
    return row


def _root(number: int, path: str) -> dict:
    try:
        stat = os.stat(path)
    except OSError as e:
        return _row(number, "error", path, "", error=type(e).__name__)
    return _row(number, "folder" if os.path.isdir(path) else "file" if os.path.isfile(path) else "other", path, "", stat)


def _members(number: int, folder: str, key: str, follow: bool) -> Iterator[dict]:
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_symlink() and not follow:
                        continue
                    if e.is_dir():
                        yield _row(number, "folder", e.path, f"{key}\x001{e.name}", e.stat())
                    elif e.is_file():
                        yield _row(number, "file", e.path, f"{key}\x000{e.name}", e.stat())
                except OSError as error:
                    yield _row(number, "error", e.path, f"{key}\x000{e.name}", error=type(error).__name__)
    except OSError as error:
        yield _row(number, "error", folder, key, error=type(error).__name__)


def _by_rows(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def walk(spark: SparkSession, roots: list[str], follow_symlinks: bool = False) -> DataFrame:
    """A row (``ROW``) for each file and each error below ``roots``; order by root_no and walk_key for the order of a plain walk.

    Where links are followed a folder is listed once over all roots; where they aren't, overlapping roots list their files each.
    Every level is stored before the next, so a lost executor repeats no more than one.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _by_rows(_root(n, p) for n, p in zip(*(c.to_pylist() for c in batch.columns)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _by_rows(m for n, p, k in zip(*(c.to_pylist() for c in batch.columns)) for m in _members(n, p, k, follow_symlinks))

    starts = spark.createDataFrame(list(enumerate(roots)), "root_no int, path string")
    level = stored(starts.mapInArrow(first, ROW), "level")
    done = [level.where("kind <> 'folder'")]
    seen = None
    while True:
        folders = level.where("kind = 'folder'")
        if follow_symlinks:
            one = folders.groupBy("device", "inode").agg(F.min(F.struct("root_no", "walk_key", "path")).alias("f"))
            if seen is not None:
                one = one.join(seen, ["device", "inode"], "left_anti")
            new = stored(one.select("device", "inode", "f.*"), "folders")
            seen = new.select("device", "inode") if seen is None else seen.union(new.select("device", "inode"))
        else:
            new = folders
        if new.isEmpty():
            break
        level = stored(new.select("root_no", "path", "walk_key").repartition(tasks(spark), "path").mapInArrow(listed, ROW), "level")
        done.append(level.where("kind <> 'folder'"))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.where("kind <> 'other'")
