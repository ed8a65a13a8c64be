"""Batches of texts in tasks: bounded by bytes, split into words as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROW_BYTES = 64


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of one chunk a column with at most ``most`` bytes of text (a longer
    text is a table of its own), cut and joined across batches; ``ROW_BYTES`` are added for each row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, base + most - size, side="right")), start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - base
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` (no nulls) in one array, and where each text's words begin and end. Words are
    runs of anything but the six ASCII white space characters."""
    split = pc.ascii_split_whitespace(texts)
    flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy() > 0  # white space at an end of a text leaves an empty word
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    return flat, ends


def translated(texts: pa.Array, bytes_table: bytes) -> pa.Array:
    """``texts`` with each byte replaced; the table maps ASCII to ASCII and keeps all other bytes."""
    texts = pa.concat_arrays([texts])  # offsets from 0
    _, ends, data = texts.buffers()
    mapped = data.to_pybytes().translate(bytes_table) if data is not None else b""
    return pa.Array.from_buffers(texts.type, len(texts), [None, ends, pa.py_buffer(mapped)], offset=texts.offset)


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` between neighbours of ``ends``, empty runs included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]
