"""Words of whole Arrow batches: one pass over the bytes, no loop over rows or words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ledgerloom.llm.common import text_buffer

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in one of the ranges, ends included."""
    held = np.zeros(256, bool)
    for first, last in ranges:
        held[first : last + 1] = True
    return held


@dataclass
class Words:
    """The words of some rows in order: `text` (A-Z lower-cased), the row and the piece of each; pieces differ between rows."""

    text: pa.Array
    row: np.ndarray
    piece: np.ndarray


def words_of(texts: pa.Array, between: np.ndarray, breaks: np.ndarray | None = None) -> Words:
    """Cut rows into maximal runs of bytes outside `between` and `breaks`; a byte of `breaks` also ends a piece."""
    body, offsets = text_buffer(texts)
    body, offsets = body[offsets[0] : offsets[-1]], offsets - offsets[0]
    breaking = None if breaks is None else breaks[body]
    inside = ~between[body] if breaking is None else ~(between[body] | breaking)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(body)]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    row = np.searchsorted(offsets, at, side="right") - 1
    kept = np.cumsum(inside, dtype=np.int64)
    ends = np.append(kept[at] - 1, kept[-1] if len(kept) else 0)
    data = _LOWER[body[inside]]
    text = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    piece = row if breaking is None else row + np.cumsum(breaking, dtype=np.int64)[at]
    return Words(text, row, piece)


def chunks(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.Table]:
    """Batches put together until their `column` holds `most_bytes`; a longer batch stands alone."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.column(column).nbytes > most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.column(column).nbytes
    if held:
        yield pa.Table.from_batches(held)
