"""Large files by ranges of bytes: a file's structure without ever holding the file.

A file is dealt as rows of ranges, whole blocks each; a task sees its range and one block on either
side. Signatures belong to the range where they begin. Runs of zeros that touch an edge are stitched
by a window over the runs' places, so a run may cross any number of ranges. The figures are those
of ``zipbytes.structure`` over the whole file. The index is read from a file's end alone, and its entries,
rows by then, are verified in portions by tasks that read only their bytes.
"""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardwright.functions.zipbytes import BLOCK, END, END_SIZE
from shardwright.session import file_batches, tasks
from shardwright.sources.retry import retrying

#: Bytes of a range, a multiple of ``BLOCK``; bytes of an entry that are read at once.
RANGE, CHUNK = 64 << 20, 1 << 20
_SIGNATURES = re.compile(rb"(?=PK(\x03\x04|\x01\x02|\x05\x06))")
_END = pa.struct([("offset", pa.int64()), ("total_entries", pa.int64()), ("cd_offset", pa.int64()), ("cd_size", pa.int64()), ("is_consistent", pa.bool_()), ("comment_length", pa.int64())])
_RUN = pa.struct([(c, pa.int64()) for c in ("low", "high", "start", "end")])
_FACTS = pa.schema([("lfh_offsets", pa.list_(pa.int64())), ("cd_sig_count", pa.int64()), ("end_at", pa.int64()), ("end", _END), ("runs", pa.list_(_RUN)), ("head", pa.binary())])
_FACTS_SQL = (
    "lfh_offsets array<bigint>, cd_sig_count bigint, end_at bigint, end struct<offset:bigint,total_entries:bigint,cd_offset:bigint,cd_size:bigint,is_consistent:boolean,comment_length:bigint>,"
    "runs array<struct<low:bigint,high:bigint,start:bigint,end:bigint>>, head binary"
)


def opened(path: str) -> BinaryIO:
    """A file to seek in: a plain path, or a URI of a store that Arrow can open."""
    if "://" not in path:
        return retrying(lambda: open(path, "rb"))[0]
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return retrying(lambda: system.open_input_file(inner))[0]


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """``files`` (size, ...) with range_no, start and stop; an empty file has one empty range."""
    last = F.greatest(F.lit(0), F.expr(f"(size - 1) div {size}"))
    rows = files.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return rows.withColumns({"start": F.col("range_no") * size, "stop": F.least(F.col("size"), (F.col("range_no") + 1) * size)})


def range_facts(piece: bytes, at: int, start: int, stop: int, size: int) -> dict:
    """Facts of [start, stop) of a file of ``size`` bytes; ``piece`` begins at ``at``, a block earlier, and ends a block later, where the file goes on."""
    lead, n = start - at, stop - start
    found: dict[bytes, list[int]] = {b"\x03\x04": [], b"\x01\x02": [], b"\x05\x06": []}
    for m in _SIGNATURES.finditer(piece, lead, min(len(piece), lead + n + 3)):
        if m.start() < lead + n:
            found[m[1]].append(at + m.start())
    end_at = found[b"\x05\x06"][-1] if found[b"\x05\x06"] else None
    end = None
    if end_at is not None and size - end_at >= END_SIZE:
        _, _, _, _, total, cd_size, cd_offset, comment = struct.unpack_from(END, piece, end_at - at)
        end = {"offset": end_at, "total_entries": total, "cd_offset": cd_offset, "cd_size": cd_size, "is_consistent": cd_offset + cd_size == end_at, "comment_length": comment}
    runs = []
    if n:
        own = np.frombuffer(piece, np.uint8, n, lead)
        empty = np.add.reduceat(own != 0, np.arange(0, n, BLOCK), dtype=np.int64) == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], empty.astype(np.int8), [0]])))
        for first, last in zip(edge[::2], edge[1::2]):
            low, high = start + int(first) * BLOCK, min(start + int(last) * BLOCK, stop)
            back, ahead = piece[max(0, low - at - BLOCK) : low - at], piece[high - at : high - at + BLOCK]
            runs.append({"low": low, "high": high, "start": low - len(back) + len(back.rstrip(b"\0")), "end": high + len(ahead) - len(ahead.lstrip(b"\0"))})
    return {"lfh_offsets": found[b"\x03\x04"], "cd_sig_count": len(found[b"\x01\x02"]), "end_at": end_at, "end": end, "runs": runs, "head": piece[:8] if start == 0 else None}


def facts_of_files(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(file_id, size, range_no, facts..., error) of files (file_id, path, size), a range a row. A range that can't be read has an error and no facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for path, total, start, stop in zip(*(batch.column(c).to_pylist() for c in (2, 1, 4, 5))):
                row, error = dict.fromkeys(_FACTS.names), None
                try:
                    with opened(path) as f:
                        at = max(0, start - BLOCK)
                        f.seek(at)
                        piece = f.read(min(total, stop + BLOCK) - at)
                        if len(piece) < min(total, stop + BLOCK) - at:
                            raise OSError("file is shorter than listed")
                        row = range_facts(piece, at, start, stop, total)
                except OSError as e:
                    error = type(e).__name__
                rows.append(row)
                errors.append(error)
            made = pa.RecordBatch.from_pylist(rows, schema=_FACTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *made.columns, pa.array(errors, pa.string())], names=["file_id", "size", "range_no", *_FACTS.names, "error"])

    kind = files.schema["file_id"].dataType.simpleString()
    dealt = ranges(files.select("file_id", F.col("size").cast("long").alias("size"), "path"), size).repartition(tasks(files.sparkSession), "file_id", "range_no")
    return dealt.mapInArrow(run, f"file_id {kind}, size bigint, range_no bigint, {_FACTS_SQL}, error string")


def facts_of_contents(files: DataFrame, size: int = RANGE) -> DataFrame:
    """``facts_of_files`` where contents are in rows already (file_id, content)."""
    sized = files.select("file_id", F.octet_length("content").cast("long").alias("size"), "content")
    at = F.greatest(F.lit(0).cast("long"), F.col("start") - BLOCK)
    piece = ranges(sized, size).withColumn("at", at).withColumn("piece", F.expr(f"substring(content, cast(at + 1 as int), cast(least(size, stop + {BLOCK}) - at as int))")).select("file_id", "size", "range_no", "start", "stop", "at", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [range_facts(piece.as_py() or b"", at, start, stop, total) for total, start, stop, at, piece in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4, 5)), batch.column(6))]
            made = pa.RecordBatch.from_pylist(rows, schema=_FACTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made.columns, pa.nulls(batch.num_rows, pa.string())], names=["file_id", "size", "range_no", *_FACTS.names, "error"])

    kind = files.schema["file_id"].dataType.simpleString()
    return file_batches(piece).mapInArrow(run, f"file_id {kind}, size bigint, range_no bigint, {_FACTS_SQL}, error string")


def structure(facts: DataFrame) -> DataFrame:
    """(file_id, size, zero_runs, lfh_offsets, cd_sig_count, eocd, head, error) of whole files from the facts of their ranges.

    A file with an unreadable range has that error and no figures.
    """
    run = facts.select("file_id", F.explode("runs").alias("r")).select("file_id", "r.*")
    own = W.partitionBy("file_id").orderBy("low")  # at most a row for each run of empty blocks in a range
    stitched = run.withColumn("_new", F.coalesce(F.col("low") > F.lag("high").over(own), F.lit(True)).cast("long")).withColumn("_run", F.sum("_new").over(own))
    whole = stitched.groupBy("file_id", "_run").agg(F.min_by("start", "low").alias("start"), F.max_by("end", "low").alias("end"))
    zero = whole.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("zero_runs"))
    rest = facts.groupBy("file_id").agg(
        F.first("size").alias("size"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "lfh_offsets"))), lambda x: x["lfh_offsets"])).alias("lfh_offsets"),
        F.sum("cd_sig_count").alias("cd_sig_count"), F.max_by(F.struct("end"), F.col("end_at")).alias("_end"), F.max("head").alias("head"), F.min("error").alias("error"),
    )
    both = rest.join(zero, "file_id", "left")
    good = lambda c: F.when(F.col("error").isNull(), c)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return both.select("file_id", "size", good(F.coalesce("zero_runs", none)).alias("zero_runs"), good(F.col("lfh_offsets")).alias("lfh_offsets"), good(F.col("cd_sig_count")).alias("cd_sig_count"), good(F.col("_end.end")).alias("eocd"), "head", "error")


_ENTRY = "name string, header_offset bigint, file_size bigint, crc bigint, comp_size bigint"


def listed_entries(files: DataFrame) -> DataFrame:
    """(file_id, path, name, header_offset, file_size, crc, comp_size) that the indexes of files (file_id, path) list, read from their ends; files without a usable index have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(1)[i].as_py()
                try:
                    with opened(path) as f, zipfile.ZipFile(f) as archive:
                        infos = archive.infolist()
                except Exception:  # whatever the reader makes of damaged bytes
                    continue
                for lo in range(0, len(infos), 4096):
                    part = infos[lo : lo + 4096]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(part), batch.schema.field(c).type) for c in (0, 1)]
                    columns = [pa.array([getattr(x, a) for x in part], pa.string() if a == "filename" else pa.int64()) for a in ("filename", "header_offset", "file_size", "CRC", "compress_size")]
                    yield pa.RecordBatch.from_arrays([*same, *columns], names=["file_id", "path", "name", "header_offset", "file_size", "crc", "comp_size"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "path").repartition(tasks(files.sparkSession), "path").mapInArrow(run, f"file_id {kind}, path string, {_ENTRY}")


def verified_entries(entries: DataFrame) -> DataFrame:
    """``listed_entries`` with ok and error, in portions of neighbouring entries: a task opens a file once and reads an entry by ``CHUNK`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, BinaryIO, zipfile.ZipFile, dict] | None = None
        for batch in batches:
            errors = []
            for path, name, offset in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                try:
                    if held is None or held[0] != path:
                        if held:
                            held[1].close()
                        f = opened(path)
                        archive = zipfile.ZipFile(f)
                        held = (path, f, archive, {(x.filename, x.header_offset): x for x in archive.infolist()})
                    with held[2].open(held[3][name, offset]) as member:
                        while member.read(CHUNK):
                            pass
                    errors.append(None)
                except Exception as e:  # whatever the reader makes of damaged bytes
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e is None for e in errors]), pa.array(errors, pa.string())], names=[*batch.schema.names, "ok", "error"])
        if held:
            held[1].close()

    kind = entries.schema["file_id"].dataType.simpleString()
    dealt = entries.select("file_id", "path", "name", "header_offset", "file_size", "crc", "comp_size").repartitionByRange(tasks(entries.sparkSession), "path", "header_offset").sortWithinPartitions("path", "header_offset")
    return dealt.mapInArrow(run, f"file_id {kind}, path string, {_ENTRY}, ok boolean, error string")

