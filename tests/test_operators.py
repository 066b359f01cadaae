"""Properties and small exact cases of the operators."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadline.operators import clean as C
from threadline.operators import clusters as K
from threadline.operators import density, merging, metric
from threadline.operators import periods as T
from threadline.operators import search as R
from threadline.operators import sentiment as N
from threadline.operators import stats as S
from threadline.operators import topics as O
from threadline.operators import vectors as V
from threadline.operators.threads import flatten_nested, flatten_threads


def test_last_period_wins_in_both_forms(spark):
    df = spark.createDataFrame([(1, "2020-01-05"), (2, "2020-01-15"), (3, "2021-01-01"), (4, None)], "id int, d string").withColumn("ts", F.col("d").cast("timestamp"))
    ps = [("a", "2020-01-01", "2020-01-20"), ("b", "2020-01-10", "2020-01-31")]
    dim = spark.createDataFrame([(n, s, e, i) for i, (n, s, e) in enumerate(ps)], "name string, s string, e string, ord int").selectExpr("name", "cast(s as timestamp) start", "cast(e as timestamp) end", "ord")
    want = {1: "a", 2: "b", 3: "Normal", 4: "Normal"}
    assert {r.id: r.p for r in df.select("id", T.period_tag(F.col("ts"), ps).alias("p")).collect()} == want
    assert {r.id: r.period for r in T.tag_periods(df, dim, "ts").collect()} == want


def test_histogram_keeps_the_maximum(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    h = S.histogram(df, F.col("x"), 10).orderBy("bin").collect()
    assert [r.n for r in h] == [10] * 9 + [11] and h[-1].hi == 100.0


def test_thread_flatten_drops_orphans(spark):
    rows = [("a", None, "r"), ("b", "a", "x"), ("c", "b", "y"), ("d", "gone", "z"), ("e", "f", None), ("f", None, None)]
    t = flatten_threads(spark.createDataFrame(rows, "id string, parent_id string, body string"))
    assert sorted((r.id, r._depth) for r in t.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_threads_have_no_depth_limit(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, 250) for i in range(5)] + [(2000, 2001), (2001, 2000), (2002, 2001), (3000, 3000)]
    t = flatten_threads(spark.createDataFrame(rows, "id long, parent_id long"))
    assert sorted((r.id, r._depth) for r in t.collect()) == [(i, i) for i in range(300)] + [(1000 + i, 251) for i in range(5)]
    with pytest.raises(RuntimeError):
        flatten_threads(spark.createDataFrame([(1, None), (2, 1), (2, 3), (3, 2)], "id long, parent_id long"))


def test_reasons_add_up(spark):
    df = spark.createDataFrame([("bob", "one two three four five"), ("bob", "lol"), (None, "x"), ("AutoModerator", "one two three four five six")], "author string, body string")
    n = {r.reason: r.n for r in C.first_reason_counts(df).collect()}
    assert sum(n.values()) == 4 and n["kept"] == 1
    assert C.clean_comments(df).count() == 1


def test_search_needs_every_token(spark):
    p = spark.createDataFrame([(1, "Oil and sanctions"), (2, "oil only"), (3, None)], "id int, text string")
    m = R.matched_queries(p, ["sanctions oil", "oil"])
    assert {r.id: r._matched_queries for r in m.collect()} == {1: ["sanctions oil", "oil"], 2: ["oil"]}


def test_density_clusters_find_blobs(spark):
    rng = np.random.default_rng(1)
    pts = [(i, [float(x) for x in rng.normal((i // 40) * 5.0, 0.2, 3)]) for i in range(80)] + [(100, [50.0, 50.0, 50.0])]
    d = density.hierarchical_clusters(spark.createDataFrame(pts, "id long, embedding array<double>"), 1.0, min_size=10, min_samples=5).collect()
    by = {r.id: r.cluster_id for r in d}
    assert by[100] == -1 and len({by[i] for i in range(40)}) == 1 and len({by[i] for i in range(40, 80)}) == 1 and by[0] != by[40]
    assert all(0 <= r.cluster_prob <= 1 for r in d)


def test_components_by_either_way(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7), (500, 501), (500, 501)]
    top = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    e = spark.createDataFrame(pairs, "a long, b long")
    assert {r.id: r.root for r in K.components(e).collect()} == top
    monkeypatch.setattr(K, "FEW_EDGES", 5)
    assert {r.id: r.root for r in K.components(e).collect()} == top
    assert K.components(e.limit(0)).count() == 0
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string")
    assert {r.id: r.root for r in K.components(words).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_evolution_and_centroids(spark):
    rows = [("p1", 0, [1.0, 0.0]), ("p1", 1, [0.0, 1.0]), ("p2", 0, [0.9, 0.1]), ("p2", 7, [-1.0, 0.0])]
    e = K.evolution(spark.createDataFrame(rows, "period string, cluster_id int, embedding array<double>"), threshold=0.5).collect()
    assert [(r.from_cluster, r.to_cluster, r.to_count) for r in e] == [(0, 0, 1)]
    c = V.centroids(spark.createDataFrame(rows, "period string, cluster_id int, embedding array<double>"), "period").collect()
    assert {r.period: r.n for r in c} == {"p1": 2, "p2": 2}


def test_plans_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a", "b")], "author string, body string")
    plan = C.clean_comments(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 301)] + [("b", float(x)) for x in rng.normal(size=200)] + [("c", 5.0), (None, 1.0), (None, 3.0), ("d", None)]
    at = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r.g, r.p): r.value for r in S.exact_percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", at).collect()}
    for g in ("a", "b", "c", None):
        v = [x for k, x in rows if k == g]
        assert all(abs(got[g, p] - np.percentile(v, 100 * p)) < 1e-9 for p in at)
    assert ("d", 0.5) not in got and S.exact_percentiles(spark.createDataFrame([], "x double"), [], "x", [0.5]).count() == 0


def test_neighbour_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(150, 6)), rng.normal(size=(60, 6)) * 0.05))
    g = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, int(g[i]), [float(v) for v in r]) for i, r in enumerate(x)], "id long, g int, embedding array<double>")
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 1.1
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    assert {(r.a, r.b) for r in metric.neighbour_pairs(df, 1.1).collect()} == want and len(want) > 1000
    assert {(r.a, r.b) for r in metric.neighbour_pairs(df, 1.1, within=("g",)).collect()} == {(i, j) for i, j in want if g[i] == g[j]}
    assert metric.neighbour_pairs(df.limit(0), 1.1).count() == 0


def test_nested_trees(spark):
    tree = {"a": {"body": "1", "parent_id": "t3_p", "score": 4, "replies": {"b": {"body": "2", "parent_id": "t1_a", "replies": {"c": {"body": "{3}", "parent_id": "t1_b"}, "x": {"score": 1, "replies": {"y": {"body": "lost"}}}}}}}, "d": {"body": "4", "replies": ""}, "c": {"body": "later"}}
    t = flatten_nested(spark.createDataFrame([("p", json.dumps(tree)), ("q", "{}"), ("r", None), ("s", "no json")], "submission_id string, tree string"))
    assert sorted((r._id, r.body, r._depth, r._is_top_level, r._parent_comment_id) for r in t.collect()) == [("a", "1", 0, True, None), ("b", "2", 1, False, "a"), ("c", "later", 0, True, None), ("d", "4", 0, True, None)]


def test_nested_trees_of_any_depth_in_one_stage(spark):
    rng = np.random.default_rng(8)

    def grow(left, depth):
        """Random trees, with comments that lack a body, ids that repeat, and odd values."""
        out = {}
        for _ in range(int(rng.integers(0, 4)) if depth else 5):
            if left[0] <= 0:
                break
            left[0] -= 1
            c = {"parent_id": f"t1_p{depth}", "score": [3, -1.5, True, None, "x", {"a": [1, "}"]}][int(rng.integers(0, 6))], "junk": ["]", {"b": 1}]}
            if rng.random() < 0.9:
                c["body"] = ["t", 'q" \\ {', "é\n", ""][int(rng.integers(0, 4))]
            c["replies"] = grow(left, depth + 1) if rng.random() < 0.8 else ["", None][int(rng.integers(0, 2))]
            out[f"c{int(rng.integers(0, 60))}"] = c
        return out

    def flat(tree, depth=0):
        out = {}
        for k, c in tree.items():
            if c.get("body") is not None:
                s = c["score"]
                out.pop(k, None)
                out[k] = (depth, c["body"], s if isinstance(s, str) or s is None else json.dumps(s))
                for k2, v in (flat(c["replies"], depth + 1) if c["replies"] else {}).items():
                    out.pop(k2, None)
                    out[k2] = v
        return out

    trees = [grow([200], 0) for _ in range(20)]
    deep = "{" + "".join(f'"d{i}": {{"body": "b", "replies": {{' for i in range(3000)) + "}}" * 3000 + "}"
    bad = ["{", "[]", '{"a": {"body": "x"}', '{"a" {"body": 1}}', '{"a": {"body": "x"}} {', "5", '{"a": {"body": "x",}', ""]
    df = spark.createDataFrame([(i, json.dumps(t, ensure_ascii=bool(i % 2))) for i, t in enumerate(trees)] + [(100, deep)] + [(200 + i, b) for i, b in enumerate(bad)], "submission_id long, tree string")
    t = flatten_nested(df)
    got = {}
    for r in t.collect():
        got.setdefault(r._submission_id, {})[r._id] = (r._depth, r.body, r.score)
    assert {i: g for i, g in got.items() if i < 100} == {i: f for i, t_ in enumerate(trees) if (f := flat(t_))}
    assert got[100] == {f"d{i}": (i, "b", None) for i in range(3000)} and max(got) == 100
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()


def test_samples_per_cluster(spark):
    rows = [(i, i % 2, float(i)) for i in range(40)] + [(100, 7, 1.0)]
    got = K.sample_texts(spark.createDataFrame(rows, "id long, cluster_id int, cluster_prob double"), n=6).collect()
    per = {c: sorted((r.sample_rank, r.id) for r in got if r.cluster_id == c) for c in (0, 1, 7)}
    assert [x for _, x in per[0][:3]] == [38, 36, 34] and [k for k, _ in per[0]] == [1, 2, 3, 4, 5, 6] and len({x for _, x in per[1]}) == 6 and per[7] == [(1, 100)]


def test_scorers_and_embedders(spark):
    df = spark.createDataFrame([(1, "good day"), (2, None), (3, "  "), (4, "bad")], "id long, text string")

    def load():
        def run(b):
            if (b == "bad").any():
                raise ValueError("the scorer's own failure")
            return pd.DataFrame({"label": ["LABEL_POS"] * len(b), "confidence": 0.5})

        return run

    one = {r.id: (r.sentiment_label, r.sentiment_score) for r in N.score_with(df.filter("id < 4").coalesce(1), load).collect()}
    assert one == {1: ("LABEL_POS", 0.5), 2: ("neutral", 0.0), 3: ("neutral", 0.0)}
    assert {r.sentiment_score for r in N.score_with(df.coalesce(1), load).collect()} == {0.0}
    assert [list(r.embedding) for r in V.embed_with(df, lambda: lambda b: [[float(len(x))] for x in b]).orderBy("id").collect()] == [[8.0], [0.0], [2.0], [3.0]]


def test_topics(spark, tmp_path):
    words = {0: "apple banana cherry grape", 1: "engine wheel motor brake", 2: "apple banana cherry melon"}
    docs = spark.createDataFrame([(i, i % 3, words[i % 3]) for i in range(90)] + [(100, -1, "noise")], "id long, topic_id int, text string")
    m = {r.topic_id: r.n for r in O.merged_topics(docs, 2).groupBy("topic_id").agg(F.count("*").alias("n")).collect()}
    assert sorted(m.values()) == [1, 30, 60] and m[-1] == 1 and m[1] == 30
    vec = docs.select("id", F.when(F.col("topic_id") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    w = O.top_per(O.class_tfidf(docs.filter("topic_id <> -1"), "topic_id", grams=(1, 2)), "topic_id", "weight", 20)
    assert any(" " in r.term for r in w.collect())
    ranked = O.reranked(w.drop("rank"), docs, vec, 3).collect()
    assert {r.topic_id for r in ranked} == {0, 1, 2} and all(abs(r.similarity - 1) < 1e-9 and r.rank <= 3 for r in ranked)
    O.save_topics(docs, w, str(tmp_path / "m"))
    d2, w2 = O.load_topics(spark, str(tmp_path / "m"))
    assert d2.count() == 91 and sorted(map(str, w2.collect())) == sorted(map(str, w.collect()))


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) * np.array([5.0, 2.0, 1.0, 0.5, 0.1])
    got = np.array([r.reduced for r in V.reduce_dimensions(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>"), 2).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(x @ axes.T), atol=1e-6)


def test_period_join_is_broadcast(spark):
    dim = spark.createDataFrame([("a", "2020-01-01", "2020-01-20", 0)], "name string, s string, e string, ord int").selectExpr("name", "cast(s as timestamp) start", "cast(e as timestamp) end", "ord")
    plan = T.tag_periods(spark.range(10).selectExpr("id", "timestamp_seconds(id) ts"), dim, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def chain(x, size, n):
    """Average linkage one merge at a time: the groups of topics that are left."""
    groups = [[i] for i in range(len(x))]
    s = x @ x.T
    like = lambda a, b: sum(size[i] * size[j] * s[i, j] for i in a for j in b) / (sum(size[i] for i in a) * sum(size[j] for j in b))
    while len(groups) > n:
        _, i, j = max((like(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] = groups[j] + groups.pop(i)
    return {frozenset(g) for g in groups}


def test_topic_reduction_is_the_chain(spark):
    rng = np.random.default_rng(21)
    base = rng.random((7, 40)) ** 4
    w = np.array([base[i % 7] + 0.4 * rng.random(40) ** 3 for i in range(50)])
    size = rng.integers(1, 60, 50).tolist()
    x = w / np.linalg.norm(w, axis=1)[:, None]
    weights = spark.createDataFrame([(i, f"t{j}", float(w[i, j])) for i in range(50) for j in range(40)], "topic_id long, term string, weight double")
    sizes = spark.createDataFrame(list(enumerate(size)), "topic_id long, size long")
    for n in (30, 4):
        got: dict = {}
        for r in merging.reduced(weights, sizes, n).collect():
            got.setdefault(r.into, set()).add(r.topic_id)
        assert {frozenset(g) for g in got.values()} == chain(x, size, n)
        assert all(into == max(g, key=lambda t: (size[t], -t)) for into, g in got.items())
    assert merging.reduced(weights.limit(0), sizes, 50).filter("topic_id <> into").count() == 0
    apart = {r.topic_id: r.into for r in merging.reduced(weights.limit(0), sizes, 48).collect()}  # nothing is alike
    least = sorted(range(50), key=lambda t: (size[t], -t))
    assert {t for t, i in apart.items() if t != i} == set(least[:2]) and {apart[t] for t in least[:2]} == {least[-1]}
    assert merging.reduced(weights.limit(0), sizes.limit(0), 3).count() == 0
