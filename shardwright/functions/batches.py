"""Rows of a kernel as Arrow batches of a useful size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a batch, and bytes of its binary values, about.
ROWS, BYTES = 2048, 4 << 20


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``rows`` in the order they come, many to a batch, few where they are large; none is held longer than its batch."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(map(_bytes, row))
        if len(held) >= ROWS or size >= BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def widened(batch: pa.RecordBatch, width: int, values: Iterable, field: pa.Field) -> Iterator[pa.RecordBatch]:
    """The first ``width`` columns of ``batch`` with a column of ``values``, one a row, in batches of a useful size."""
    held, first, size = [], 0, 0
    for i, value in enumerate(values):
        held.append(value)
        size += _bytes(value)
        if len(held) >= ROWS or size >= BYTES or i + 1 == batch.num_rows:
            yield pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in batch.columns[:width]), pa.array(held, field.type)], names=[*batch.schema.names[:width], field.name])
            held, first, size = [], i + 1, 0


def _bytes(value) -> int:
    """Bytes of a binary value, or of those inside lists of rows."""
    if isinstance(value, (list, tuple)):
        return sum(map(_bytes, value))
    return len(value) if isinstance(value, (bytes, memoryview)) else 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(zip(*rows), schema)], schema=schema)
