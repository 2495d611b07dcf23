"""Token occurrences packed for an exchange: a row per packet, not per occurrence.

A packet is one compressed binary of several arrays.  Bytes of equal weight lie
together, so that the upper ones of small numbers cost nothing.  What a table
carries per document goes once per packet, not with each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return head + pa.compress(body, "zstd", asbytes=True)


def lengths(packet: bytes, arrays: int) -> list[int]:
    return np.frombuffer(packet, np.int64, arrays).tolist()


def unpack(packet: bytes, *types: type) -> list[np.ndarray]:
    """The arrays of a packet, by their types."""
    n = np.frombuffer(packet, np.int64, len(types))
    ends = np.cumsum([k * np.dtype(t).itemsize for k, t in zip(n, types)])
    body = np.frombuffer(pa.decompress(packet[8 * len(types):], int(ends[-1]), "zstd"), np.uint8)
    return [np.ascontiguousarray(body[end - k * np.dtype(t).itemsize:end].reshape(-1, k).T).view(t).ravel() if k else np.empty(0, t)
            for k, t, end in zip(n, types, ends)]


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, small ones of either sign as small numbers."""
    d = np.diff(values.astype(np.int32), prepend=np.int32(0))
    return (d << 1) ^ (d >> 31)


def summed(found: np.ndarray) -> np.ndarray:
    """The values of ``steps``."""
    return np.cumsum((found >> 1) ^ -(found & 1), dtype=np.int32)


def column(values: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for nulls), and which are no nulls."""
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(kind), pc.is_valid(values).to_numpy(zero_copy_only=False).view(np.uint8)


def spread(values: np.ndarray) -> np.ndarray:
    """A hash of whole numbers."""
    x = values.astype(np.int64).view(np.uint64).copy()
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def starts_of_runs(values: np.ndarray) -> np.ndarray:
    """Where values that differ from the one before stand."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def gathered(batches: Iterator[pa.RecordBatch], weight, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` in weight (an int array, by ``weight(batch)``); a heavier row is alone."""
    kept, held = [], 0
    for batch in batches:
        w = np.cumsum(weight(batch))
        at = 0
        while at < len(w):
            before = w[at - 1] if at else 0
            to = max(int(np.searchsorted(w, before + most - held, "right")), at if kept else at + 1)
            if to > at:
                kept.append(batch.slice(at, to - at))
                held += int(w[to - 1] - before)
            if to < len(w):
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, held = [], 0
            at = to
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
