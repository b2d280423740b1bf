"""Columns of whole numbers as byte planes: what is nearly constant in a plane costs nearly nothing in a
compressed shuffle, and one row carries thousands of entries."""

from __future__ import annotations

import numpy as np

#: Stands for a null id inside packed columns; orders before all other ids.
NULL_ID = np.iinfo(np.int64).min


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def deltas(x: np.ndarray) -> bytes:
    """Planes of the differences of neighbours, modulo the type's range."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def undeltas(data: bytes, dtype) -> np.ndarray:
    x = unplanes(data, dtype)
    return np.cumsum(x, dtype=dtype)


def by_bucket(bucket: np.ndarray, count: int):
    """``(bucket, places)`` of every bucket that occurs, places ascending."""
    order = np.argsort(bucket.astype(np.uint16 if count <= 65536 else np.uint32), kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    return zip(found.tolist(), np.split(order, at[1:]), strict=True) if len(found) else ()
