"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from ..sources.tables import shared_folder, written  # noqa: F401

#: ASCII white space of the contracts: \x20 and \x09-\x0D.
SPACE = "\\x20\\x09-\\x0D"


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string column; a null is an empty text."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        void = np.asarray(column.is_null())
        ends[void] = starts[void]
    return data, starts, ends


def texts(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; a null is an empty text."""
    data, starts, ends = utf8(column)
    view = memoryview(data)
    return [bytes(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` text bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts, ends = utf8(batch.column(column))
        part = np.cumsum(ends - starts) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
