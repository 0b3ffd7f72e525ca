"""Arrow batches re-cut into blocks of texts of like length, small enough for flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clickloom.llm.textbytes import buffers


def blocks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Every row once, in blocks of about ``size`` bytes of text, shorter texts first, each with its bytes and offsets.

    A longer text is a block of its own. Texts of like length share a block, so
    that work by rounds ends about together for all of them.
    """
    _, offsets = buffers(batch.column(column))
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    filled = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        before = filled[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(filled, before + size, "right")))
        part = batch.take(pa.array(order[at:to]))
        yield part, *buffers(part.column(column))
        at = to
