"""Shuffles of number columns in packed form.

Rows whose columns are 8-byte numbers are dealt to buckets by a key; a task
sends each bucket one row that holds its share of the columns as bytes, so a
shuffle moves arrays instead of rows, and both ends work on them with numpy;
tables in this form are written and read back as they are. A bucket is a share
of the keys' hash bits, BUCKETS of them a shuffle partition, and a task holds one
at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import give_back
from .common import partitions

#: Buckets a shuffle partition, and rows that a task packs together.
BUCKETS, PACK_ROWS = 1, 1 << 19
PACKED = "bucket int, side int, rows binary"


def buckets(df: DataFrame) -> int:
    return BUCKETS * partitions(df.sparkSession)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets of hashed keys."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


LOW48 = np.uint64((1 << 48) - 1)


def narrow(keys: np.ndarray) -> bytes:
    """The lower 48 bits of hashes, six bytes each."""
    return keys.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widened(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def slices(x: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal values."""
    if not len(x):
        return []
    cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def as_longs(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.ascontiguousarray(c).view(np.int64) for c in columns])


def pack(x: np.ndarray, side: int, n: int) -> pa.RecordBatch:
    """Columns (rows of x, the key first) by bucket."""
    deal = bucket_of(x[0], n)
    order = np.argsort(deal, kind="stable")
    deal, x = deal[order], x[:, order]
    cut = slices(deal)
    return pa.RecordBatch.from_arrays(
        [pa.array([int(deal[s]) for s, _ in cut], pa.int32()), pa.array([side] * len(cut), pa.int32()), pa.array([x[:, s:e].tobytes() for s, e in cut], pa.binary())], names=["bucket", "side", "rows"]
    )


def columns_of(b: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """The column arrays (as integers of 8 bytes) of each packed row."""
    return [np.frombuffer(r, np.int64).reshape(width, -1) for r in b.column("rows").to_pylist()]


def dealt(rows: DataFrame, columns: Callable[..., list[np.ndarray]], side: int, width: int = 0) -> DataFrame:
    """Rows in packed form by a new key; `columns` gives a batch's numbers, or those of a packed row of so many columns, the key first."""
    n = buckets(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for part in columns_of(b, width) if width else [b] if b.num_rows else []:
                held.append(as_longs(columns(part)))
                size += held[-1].shape[1]
                if size >= PACK_ROWS:
                    yield pack(np.concatenate(held, axis=1), side, n)
                    held, size = [], 0
        if held:
            yield pack(np.concatenate(held, axis=1), side, n)
        held = []
        give_back()

    return rows.mapInArrow(run, PACKED)


def gathered(rows: DataFrame, columns: Callable[[np.ndarray], list[np.ndarray]], width: int, out: int) -> np.ndarray:
    """What `columns` gives of packed rows, on the driver; for selections of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [as_longs(columns(x)) for x in columns_of(b, width)]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in found if f.size], pa.binary())], names=["rows"])

    got = rows.mapInArrow(run, "rows binary").toArrow()["rows"].to_pylist()
    return np.concatenate([np.frombuffer(r, np.int64).reshape(out, -1) for r in got] or [np.zeros((out, 0), np.int64)], axis=1)


def met(sides: list[DataFrame], widths: list[int], each: Callable[..., list[np.ndarray] | dict], names: list[str] | None = None, schema: str = "", side: int = 0) -> DataFrame:
    """Packed sides bucket by bucket: `each` gets an array of columns a side and gives columns.

    These are packed again by the first (as this side, or as several sides from
    a dictionary), or become rows with the names.
    """
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionAll(s)
    n, parts = buckets(rows), partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, [[] for _ in widths]

        def done() -> Iterator[pa.RecordBatch]:
            out = each(*[np.concatenate([np.frombuffer(r, np.int64).reshape(w, -1) for r in h], axis=1) if h else np.zeros((w, 0), np.int64) for h, w in zip(held, widths, strict=True)])
            if names is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
                return
            for which, columns in (out if isinstance(out, dict) else {side: out}).items():
                yield pack(as_longs(columns), which, n)

        for b in batches:
            for k, which, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket:
                    if bucket is not None:
                        yield from done()
                    bucket, held = k, [[] for _ in widths]
                held[which].append(r)
        if bucket is not None:
            yield from done()
        held = []
        give_back()

    return rows.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, PACKED if names is None else schema)
