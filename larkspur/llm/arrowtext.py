"""Texts in Arrow batches as one byte array."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20


def released() -> None:
    """Give back what this worker has freed: workers live on, and what they keep counts as the executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in parts of at most limit bytes of text; a longer text has a part of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        for at, n in enumerate(sizes):
            if size and size + n > limit:
                held.append(batch.slice(start, at - start))
                yield whole(held)
                released()
                start, size = at, 0
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield whole(held)
        released()


def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    out = pa.concat_batches(held) if len(held) > 1 else held[0]
    held.clear()
    return out


def texts(column: pa.Array) -> list[bytes]:
    """The bytes of each text; a null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def joined(items: list[bytes], pad: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All items in one array, each after pad; where each starts and ends."""
    buf = np.frombuffer(b"".join(x for item in items for x in (pad, item)), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, items), np.int64, len(items)) + len(pad))
    return buf, ends - np.fromiter(map(len, items), np.int64, len(items)), ends
