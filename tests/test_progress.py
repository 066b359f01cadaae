"""Completeness of shards over restarts."""

from datetime import datetime, timedelta

import pandas as pd

from threadline.streaming import progress as G
from threadline.streaming import streams as Z

POST, DONE = "shard string, id string, num_comments int, ts timestamp", "shard string, id string, ts timestamp"


def test_completeness_goes_on_after_a_restart(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    p, d, base = str(tmp_path / "posts"), str(tmp_path / "done"), str(tmp_path / "run")

    def go(posts, done):
        spark.createDataFrame(posts, POST).write.mode("append").parquet(p)
        spark.createDataFrame(done, DONE).write.mode("append").parquet(d)
        s = G.stream_completeness(spark.readStream.schema(POST).parquet(p), spark.readStream.schema(DONE).parquet(d), 2, "6 hours", "1 hour")
        Z.run_available(s, base + "/out", base + "/checkpoint")
        return sorted(tuple(r) for r in spark.read.schema(G.OUT).parquet(base + "/out").collect())

    one = go([("a", "1", 5, at(0)), ("a", "2", 1, at(0)), ("b", "3", 2, at(1)), ("b", "4", 3, at(1)), ("c", "5", 1, at(1)), (None, "9", 5, at(0)), ("a", None, 5, at(0))], [("a", "1", at(1)), ("a", "1", at(1)), ("b", "3", at(1)), ("d", "7", at(1))])
    assert one == [("a", 1, 1, 1, True)]
    two = go([("e", "6", 4, at(2))], [("b", "4", at(2)), ("b", "3", at(2))])  # what was known of b before the restart counts
    assert two == [("a", 1, 1, 1, True), ("b", 1, 2, 2, True)]
    three = go([("a", "8", 9, at(3)), ("end", "0", 0, at(100))], [])  # a opens again and stays open, e was never done
    assert three == [("a", 1, 1, 1, True), ("a", 2, 2, 1, False), ("b", 1, 2, 2, True), ("e", 1, 1, 0, False)]


def test_the_store_is_asked_once_for_a_post():
    """A batch's rows of one post are one question, and posts that are neither wanted nor done are none."""
    class Store:
        def __init__(self):
            self.at, self.calls, self.timers = {}, 0, []

        def getValue(self, key):
            self.calls += 1
            return self.at.get(key)

        def containsKey(self, key):
            self.calls += 1
            return key in self.at

        def updateValue(self, key, value):
            self.calls += 1
            self.at[key] = value

        def exists(self):
            return bool(self.at)

        def get(self):
            return self.at["v"]

        def update(self, value):
            self.at["v"] = value

        def registerTimer(self, due):
            self.timers.append(due)

    p = G.ShardProgress(1000)
    p.handle = p.posts = posts = Store()
    p.counts = Store()
    ts = pd.to_datetime(["2024-01-01"] * 6 + ["2024-01-02"])
    b = pd.DataFrame({"id": ["1", "1", "2", "3", "3", "1", "4"], "wanted": [True, False, True, False, False, True, False], "done": [False, True, False, False, False, False, True], "ts": ts})
    assert list(p.handleInputRows(("s",), iter([b, b[:0]]), None))[0].values.tolist() == [["s", 1, 2, 2, True]]
    assert p.counts.at["v"] == (1, 2, 2, True, int(ts[-1].timestamp() * 1000) + 1000) and set(posts.at) == {("1",), ("2",), ("4",)}
    assert posts.calls == 6  # asked and updated, for three posts


class Kept:
    """A state variable that counts how often it is asked."""

    def __init__(self):
        self.at, self.calls = {}, 0

    def asked(self, x=None):
        self.calls += 1
        return x

    def getValue(self, key):
        return self.asked(self.at.get(key))

    def updateValue(self, key, value):
        self.at[self.asked(key)] = value

    def removeKey(self, key):
        self.asked(self.at.pop(key))

    def exists(self):
        return bool(self.at)

    def get(self):
        return self.at["v"]

    def update(self, value):
        self.at["v"] = value

    def clear(self):
        self.at = {}


class Handle:
    def __init__(self):
        self.kept = {}

    def getMapState(self, name, key, value):
        return self.kept.setdefault(name, Kept())

    getValueState = lambda self, name, schema: self.kept.setdefault(name, Kept())
    registerTimer = deleteTimer = lambda self, due: None


def used_processor(spark, monkeypatch, tmp_path):
    """The processor that the operator hands to Spark."""
    from pyspark.sql.group import GroupedData

    seen = []
    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", lambda self, p, *a, **k: seen.append(p))
    spark.createDataFrame([], POST).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([], DONE).write.parquet(str(tmp_path / "d"))
    G.stream_completeness(Z.stream_table(spark, str(tmp_path / "p")), Z.stream_table(spark, str(tmp_path / "d")), 2, "6 hours", "1 hour")
    return seen[0]


def test_posts_are_settled_by_the_block(spark, monkeypatch, tmp_path):
    """The store is asked for blocks of posts: far fewer questions than posts, also when a shard's blocks are cut anew, with the counts of a plain map."""
    import numpy as np

    monkeypatch.setattr(G, "BLOCK", 64, raising=False)
    monkeypatch.setattr(G, "BLOCKS", 4, raising=False)
    p, handle, rng, want, rows = used_processor(spark, monkeypatch, tmp_path), Handle(), np.random.default_rng(4), {}, 0
    p.init(handle)
    for size in (1, 40, 0, 900, 5000, 5000):
        ids = [["é" * (int(i) % 4) + str(i), ""][int(i) == 7] for i in rng.integers(0, 4000, size)]
        hashes = [5 if len(i) < 3 else int(i.strip("é")) * 2654435761 % (1 << 40) - (1 << 39) for i in ids]  # short ids share one
        b = pd.DataFrame({"id": pd.Series(ids, dtype=object), "h": np.array(hashes, np.int64), "wanted": rng.random(size) < 0.4, "done": rng.random(size) < 0.4, "ts": pd.to_datetime(["2024-01-01"] * size)})
        for i, w, d in zip(b["id"], b["wanted"], b["done"], strict=True):
            if w or d:
                was = want.get(i, (False, False))
                want[i] = (was[0] or w, was[1] or d)
        rows += size
        list(p.handleInputRows(("s",), iter([b[: size // 2], b[size // 2 :]]), None))
        assert handle.kept["counts"].get()[1:3] == (sum(w for w, _ in want.values()), sum(d for _, d in want.values()))
    assert handle.kept["posts"].calls < rows / 10 and handle.kept["size"].get() == (len(want), 128)  # cut for all rows of a batch that may be new
    t = G.from_blocks([v[0] for v in handle.kept["posts"].at.values()])
    assert {i: (w, d) for i, w, d in zip(*(t[c].to_pylist() for c in ("id", "wanted", "done")), strict=True)} == want and t.num_rows == len(want)
    before = dict(handle.kept["posts"].at)
    list(p.handleInputRows(("s",), iter([b]), None))  # nothing new: no block is written
    assert all(handle.kept["posts"].at[k] is v for k, v in before.items())
    list(p.handleExpiredTimer(("s",), None, None))
    assert not any(k.at for k in handle.kept.values())
