"""Arrow batches in Python workers: read a few files at a time and written as soon as these are done, so that what a worker
holds depends on the largest file, not on the table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes that are worked on at once, and rows of a batch that goes out.
ROWS, BYTES, MOST = 256, 1 << 20, 8192


def slices(batch: pa.RecordBatch, column: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of at most so many rows and so many bytes of a column of texts or files, at least a row each."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def of_kinds(found: Iterable[tuple[str, dict]], columns: dict[str, list[str]], types: dict[str, pa.DataType], most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Batches of (kind, row), each of one kind: a column ``kind`` and those of ``types``, null where the kind has none."""
    held: dict[str, list[dict]] = {k: [] for k in columns}

    def batch(kind: str) -> pa.RecordBatch:
        rows, has = held[kind], set(columns[kind])
        arrays = [pa.array([r.get(n) for r in rows], t) if n in has else pa.nulls(len(rows), t) for n, t in types.items()]
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), *arrays], names=["kind", *types])

    for kind, row in found:
        held[kind].append(row)
        if len(held[kind]) >= most:
            yield batch(kind)
    for kind in columns:
        if held[kind]:
            yield batch(kind)
