"""Sketches and tables that are stored by key."""

import numpy as np
from pyspark.sql import functions as F

from threadline.operators import sketches as K
from threadline.sources import bucketed as B


def test_sketches_of_every_level_keep_the_bound(spark):
    rng = np.random.default_rng(31)
    rows = [(f"c{i % 3}", int(m), int(a)) for i, (m, a) in enumerate(zip(rng.integers(1, 5, 30000), rng.zipf(1.3, 30000) % 20000, strict=True))] + [("c0", 1, None), (None, 2, 7), ("nobody", 1, None)]
    df = spark.createDataFrame(rows, "c string, m int, a long")
    half = K.distinct_sketches(df.filter("m <= 2"), ["c", "m"], "a")
    s = K.refreshed(half, df.filter("m > 2"), ["c", "m"], "a")
    for level in (["c", "m"], ["m"], ["c"], []):
        got = {tuple(r[:-2]): (r.rows, r.distinct) for r in K.estimates(K.rolled_up(s, level)).select(*level, "rows", "distinct").collect()}
        at = [("c", "m").index(x) for x in level]
        want: dict = {}
        for r in rows:
            want.setdefault(tuple(r[i] for i in at), []).append(r[2])
        assert set(got) == set(want)
        for k, v in want.items():
            exact = len({x for x in v if x is not None})
            assert got[k][0] == len(v) and abs(got[k][1] - exact) <= K.error_bound() * exact
    again = K.estimates(K.rolled_up(K.refreshed(s, df, ["c", "m"], "a"), []))  # rows counted twice add nothing
    assert again.first().distinct == K.estimates(K.rolled_up(s, [])).first().distinct
    assert K.estimates(K.distinct_sketches(df.limit(0), ["c"], "a")).count() == 0
    assert K.estimates(K.distinct_sketches(df.withColumn("x", F.col("a") / 2), [], "x")).first().distinct > 0


def test_joins_of_stored_tables_need_no_shuffle(spark, tmp_path):
    work = spark.createDataFrame([(i, i % 7) for i in range(500)] + [(None, 1)], "id long, n int")
    done = spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(0,), (None,)], "id long")
    w = B.save_bucketed(work, str(tmp_path / "work"), buckets=4)
    d = B.save_bucketed(done, str(tmp_path / "done"), buckets=4)
    left = B.still_to_do(w, d)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id if r.id is not None else -1 for r in left.collect()) == [-1] + [i for i in range(500) if i % 3]
    again = B.opened(spark, str(tmp_path / "work"), "id long, n int", buckets=4)
    found = B.looked_up(d, again)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and found.count() == 168 and found.filter("id = 3").first().n == 3 and found.filter("id is null").first().n is None
    assert B.still_to_do(w, B.save_bucketed(done.limit(0), str(tmp_path / "none"), buckets=4)).count() == 501
