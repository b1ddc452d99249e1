"""Messages between chunks of documents and buckets of hashes.

A chunk (documents by a hash of their id, of bounded bytes) tells each bucket (a range of hashes) every value
once; a bucket answers each chunk that told it something. What travels is one binary row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

MESSAGE = "bucket int, chunk int, data binary"
ANSWER = "chunk int, data binary"
#: Bits of a value that only has to tell most others apart.
NARROW = np.uint64(40)


def narrow(values: np.ndarray) -> bytes:
    """Sorted 40-bit values, five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def to_buckets(chunk: int, values: np.ndarray, bits: int, buckets: int,
                pack: Callable[[int, int], bytes]) -> pa.Table:
    """One message for each bucket that gets entries low..high of the sorted values."""
    which = ((values >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(which, np.arange(buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cuts))
    return pa.table({"bucket": pa.array(used.astype(np.int32)),
                     "chunk": pa.array(np.full(len(used), chunk, np.int32)),
                     "data": pa.array([pack(int(cuts[b]), int(cuts[b + 1])) for b in used], pa.binary())})


def distinct(values: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the smallest document of each and whether there are several."""
    if not len(values):
        return values, documents, np.zeros(0, bool)
    order = np.lexsort((documents, values))
    values, documents = values[order], documents[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    last = np.r_[first[1:], len(values)] - 1
    return values[first], documents[first], documents[first] != documents[last]


def shared_values(table: pa.Table) -> pa.Table:
    """A bucket's answers: to each chunk the values it told that another chunk, or several documents, have too."""
    chunk, values, several = [], [], []
    for c, data in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist(), strict=True):
        many = len(data) // 6
        values.append(wide(data[:5 * many]))
        several.append(np.frombuffer(data, np.uint8, offset=5 * many))
        chunk.append(np.full(many, c, np.int32))
    value, owner = np.concatenate(values), np.concatenate(chunk)
    order = np.argsort(value, kind="stable")
    value, owner, twice = value[order], owner[order], np.concatenate(several)[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    shared = np.add.reduceat(twice, first, dtype=np.int64) + np.diff(np.r_[first, len(value)]) > 1
    keep = np.repeat(shared, np.diff(np.r_[first, len(value)]))
    value, owner = value[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    who, at = np.unique(owner, return_index=True)
    return pa.table({"chunk": pa.array(who, pa.int32()),
                     "data": pa.array([narrow(v) for v in np.split(value, at[1:])] if len(who) else [],
                                      pa.binary())})


def with_flags(values: np.ndarray, flags: np.ndarray) -> Callable[[int, int], bytes]:
    """Packs entries low..high of sorted 40-bit values, then a byte each: whether several documents have it."""
    marks = flags.astype(np.uint8)
    return lambda low, high: narrow(values[low:high]) + marks[low:high].tobytes()


def told(answers: pa.Table) -> np.ndarray:
    """All 40-bit values of a chunk's answers, sorted."""
    data = [wide(d) for d in answers.column("data").to_pylist()]
    return np.sort(np.concatenate(data)) if data else np.zeros(0, np.uint64)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values
