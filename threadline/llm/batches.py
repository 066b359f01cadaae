"""Numpy and Arrow helpers for runs of texts that are worked on together inside a task."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts in one run.
RUN = 1 << 23


def runs(sizes: list[int], most: int = RUN) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about `most`."""
    at = n = 0
    for i, s in enumerate(sizes):
        n += s
        if n >= most:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] times, then the same of the next."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def joined(strings: pa.LargeStringArray) -> str:
    """The strings end to end."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return bytes(memoryview(strings.buffers()[2])[at[0] : at[-1]]).decode("utf-8", "surrogatepass")


def distinct_parts(raw: bytes, begin: np.ndarray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """For parts that begin at these bytes and end at the next one's: which distinct part each is, and those."""
    offsets = np.append(begin, len(raw)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    return parts.indices.to_numpy(), parts.dictionary


def lists(ids: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(ids))


def checksums(ids: np.ndarray, count: np.ndarray) -> list[int]:
    """CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    view = memoryview(np.ascontiguousarray(ids).astype("<i4", copy=False)).cast("B")
    end = (4 * np.cumsum(count)).tolist()
    return [zlib.crc32(view[s:e]) for s, e in zip([0, *end[:-1]], end, strict=True)]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task and is one of several on its machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
