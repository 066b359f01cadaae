"""Completeness of shards as state: which posts of a shard are wanted, and which are done, over any number of restarts.

Every question to the state store is a message from the Python worker to the
JVM, so posts are not kept one by one but in blocks (`BlockProgress`).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "shard string, n long, eligible long, processed long, complete boolean"
#: Posts of a block at most, as long as their hashes spread; rows that are settled at once; blocks that are read at once.
BLOCK, GATHERED, BLOCKS = 2048, 250_000, 64


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's state worker has Spark's own path only


class ShardProgress(StatefulProcessor):
    """One shard: a map of its posts (wanted, done) and its counts.

    The map is kept in the state store, post by post, so a shard need not fit
    into a task. A row is put out whenever new rows leave the shard complete with
    other counts than its last row had, and one that is not complete when nothing has come for `wait_ms` of event time; then the
    shard's state goes.
    """

    KEPT = ("id string", "wanted boolean, done boolean")

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.posts = handle.getMapState("posts", *self.KEPT)
        self.counts = handle.getValueState("counts", "n long, eligible long, processed long, complete boolean, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, eligible, processed, complete, due = self.counts.get() if self.counts.exists() else (0, 0, 0, False, -1)
        before, last = (eligible, processed), -1
        for b in rows:
            if not len(b):
                continue
            last = max(last, int(b["ts"].max().timestamp() * 1000))
            more = self.settled(b[b["wanted"] | b["done"]])  # the store is not asked for rows that say nothing of their post
            eligible += more[0]
            processed += more[1]
        if last + self.wait_ms > due:
            if due >= 0:
                self.handle.deleteTimer(due)
            due = last + self.wait_ms
            self.handle.registerTimer(due)
        full = eligible > 0 and processed >= eligible
        if full and (not complete or before != (eligible, processed)):
            n += 1
            yield self.row(key, n, eligible, processed, True)
        self.counts.update((n, eligible, processed, full, due))

    def settled(self, b: pd.DataFrame) -> tuple[int, int]:
        """How many posts are newly wanted and newly done; the store is asked once for each post of a batch."""
        eligible = processed = 0
        for id_, wanted, done in b.groupby("id", sort=False)[["wanted", "done"]].any().itertuples(name=None):
            was = tuple(self.posts.getValue((id_,)) or (False, False))
            now = (was[0] or bool(wanted), was[1] or bool(done))
            if now != was:
                self.posts.updateValue((id_,), now)
                eligible += now[0] - was[0]
                processed += now[1] - was[1]
        return eligible, processed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, eligible, processed, complete, _ = self.counts.get()
        if eligible > 0 and not complete:
            yield self.row(key, n + 1, eligible, processed, False)
        self.posts.clear()
        self.counts.clear()

    def row(self, key, n: int, eligible: int, processed: int, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "n": [n], "eligible": [eligible], "processed": [processed], "complete": [complete]})

    def close(self) -> None:
        pass


POSTS = pa.schema([("h", pa.int64()), ("id", pa.string()), ("wanted", pa.bool_()), ("done", pa.bool_())])


def to_block(t: pa.Table) -> bytes:
    """Posts as bytes: their number, hashes, lengths of ids, flags, ids."""
    ids = pa.concat_arrays([pa.array([], pa.string()), *t["id"].chunks])
    at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    flags = t["wanted"].to_numpy().astype(np.uint8) + 2 * t["done"].to_numpy().astype(np.uint8)
    text = ids.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
    return b"".join((np.int64(len(ids)).tobytes(), t["h"].to_numpy().astype(np.int64).tobytes(), np.diff(at).astype(np.int32).tobytes(), flags.astype(np.uint8).tobytes(), text))


def from_blocks(blocks: list[bytes]) -> pa.Table:
    """The posts of some blocks."""
    if not blocks:
        return POSTS.empty_table()
    h, lengths, flags, text = [], [], [], []
    for b in blocks:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        h.append(np.frombuffer(b, np.int64, n, 8))
        lengths.append(np.frombuffer(b, np.int32, n, 8 + 8 * n))
        flags.append(np.frombuffer(b, np.uint8, n, 8 + 12 * n))
        text.append(bytes(b[8 + 13 * n :]))
    f, at = np.concatenate(flags), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
    ids = pa.StringArray.from_buffers(len(f), pa.py_buffer(at), pa.py_buffer(b"".join(text)))
    return pa.table([np.concatenate(h), ids, f & 1 > 0, f & 2 > 0], schema=POSTS)


def distinct(t: pa.Table) -> pa.Table:
    """A row a post, wanted or done if any of its rows is."""
    g = t.group_by(["h", "id"], use_threads=False).aggregate([("wanted", "any"), ("done", "any")])
    return pa.table([g["h"], g["id"], g["wanted_any"], g["done_any"]], schema=POSTS)


class BlockProgress(ShardProgress):
    """The same, with the shard's posts kept in blocks by hash of the id, so that one question settles all rows of a block.

    A shard begins with as many blocks as its first rows fill, a power of two;
    when it outgrows them all are cut anew, one after the other. A task holds the
    rows of GATHERED rows and BLOCKS blocks. Ids are kept whole: equal hashes do no harm.
    """

    KEPT = ("block long", "posts binary")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.size = handle.getValueState("size", "kept long, blocks long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return super().handleInputRows(key, self.gathered(rows), timerValues)

    def gathered(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in rows:
            held.append(b)
            n += len(b)
            if n >= GATHERED:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def settled(self, b: pd.DataFrame) -> tuple[int, int]:
        if not len(b):
            return 0, 0
        new = distinct(pa.table([b[c].to_numpy() for c in POSTS.names], schema=POSTS))
        kept, blocks = self.size.get() if self.size.exists() else (0, 1)
        before = (kept, blocks)
        blocks = self.cut(kept, blocks, kept + new.num_rows)
        eligible = processed = 0
        block = new["h"].to_numpy() & (blocks - 1)
        order = np.argsort(block, kind="stable")
        new, block = new.take(pa.array(order)), block[order]
        names, first = np.unique(block, return_index=True)
        first = np.append(first, len(block))
        for i in range(0, len(names), BLOCKS):
            some = names[i : i + BLOCKS].tolist()
            had = {x: was[0] for x in some if (was := self.posts.getValue((x,)))} if kept else {}
            old = from_blocks(list(had.values()))
            rows = new.slice(first[i], first[min(i + BLOCKS, len(names))] - first[i])
            now = distinct(pa.concat_tables([old, rows])) if had else rows
            of = lambda t: t["h"].to_numpy() & (blocks - 1)
            facts = lambda t: np.stack([np.bincount(np.searchsorted(some, of(t)), w, len(some)) for w in (None, t["wanted"].to_numpy(), t["done"].to_numpy())])
            more = facts(now) - facts(old)
            now = now.take(pa.array(np.argsort(of(now), kind="stable")))
            ends = np.concatenate([[0], np.cumsum(facts(now)[0])]).astype(np.int64)
            for j in np.flatnonzero(more.any(axis=0)).tolist():  # blocks that learn nothing stay as they are
                self.posts.updateValue((some[j],), (to_block(now.slice(ends[j], ends[j + 1] - ends[j])),))
            n, e, p = more.sum(axis=1).astype(np.int64).tolist()
            kept, eligible, processed = kept + n, eligible + e, processed + p
        if (kept, blocks) != before:
            self.size.update((kept, blocks))
        return eligible, processed

    def cut(self, kept: int, blocks: int, most: int) -> int:
        """Blocks for up to `most` posts; the ones there are cut into as many."""
        wanted = blocks
        while wanted * BLOCK < most:
            wanted *= 2
        if kept and wanted > blocks:
            for x in range(blocks):
                was = self.posts.getValue((x,))
                if not was:
                    continue
                t = from_blocks([was[0]])
                to = t["h"].to_numpy() & (wanted - 1)
                for y in np.unique(to).tolist():
                    self.posts.updateValue((y,), (to_block(t.filter(pa.array(to == y))),))
                if not (to == x).any():
                    self.posts.removeKey((x,))
        return wanted

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        self.size.clear()


def stream_completeness(posts: DataFrame, done: DataFrame, min_comments: int, wait: str = "1 day", delay: str = "1 day", shard: str = "shard", id: str = "id", ts: str = "ts", comments: str = "num_comments") -> DataFrame:
    """(shard, n, eligible, processed, complete): streams of posts and of posts that are done, each with shard, id and time.

    A row comes when a shard becomes complete or its counts change while it is (n
    counts its rows; later posts may also open it again), or when it is still open `wait` after its last row. Posts
    and done ones may repeat and come in any order, within `delay`. Rows without
    a shard, an id or a time go. A restart goes on from the checkpoint; one that was written when posts were kept one by one is refused.
    """
    spark = posts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # map state needs it
    cols = lambda d, wanted, is_done: d.select(F.col(shard).cast("string").alias("shard"), F.col(id).cast("string").alias("id"), F.col(ts).alias("ts"), wanted.alias("wanted"), is_done.alias("done"))
    want = F.coalesce(F.col(comments) >= min_comments, F.lit(False))
    rows = cols(posts, want, F.lit(False)).unionByName(cols(done, F.lit(False), F.lit(True))).dropna(subset=["shard", "id", "ts"]).withWatermark("ts", delay)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    return rows.withColumn("h", F.xxhash64("id")).groupBy("shard").transformWithStateInPandas(BlockProgress(wait_ms), OUT, "Append", "EventTime")
