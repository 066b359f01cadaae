"""Metric partitions and hierarchical density clusters against brute force."""

import numpy as np

from threadline.operators import density, metric


def blobs(seed=0):
    """Three densities, one of them with two close parts, copies, scattered points."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal((0, 0, 0), 0.5, (140, 3)), rng.normal((12, 0, 0), 1.2, (110, 3)), rng.normal((0, 14, 0), 0.4, (60, 3)), rng.normal((3.5, 14, 0), 0.4, (60, 3)), rng.uniform(-25, 25, (70, 3)), np.tile((6.0, 6.0, 6.0), (30, 1))]
    return np.concatenate(parts).round(3)


def brute(v, radii, min_size, min_samples):
    """The tree of all pairs' rungs, component by component, and its clusters by excess of mass."""
    n, rate = len(v), [1 / r for r in radii]
    d = metric.distances(v, v)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)] if n > min_samples else np.full(n, np.inf)
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))

    def parts(members, r):
        left, out = [m for m in members if core[m] <= radii[r]], []
        left = set(left)
        while left:
            todo = [left.pop()]
            group = set(todo)
            while todo:
                x = todo.pop()
                new = {y for y in left if reach[x, y] <= radii[r]}
                left -= new
                group |= new
                todo += new
            out.append(frozenset(group))
        return out

    label, prob = {}, {}

    def solve(members, r):
        """Walk down from a component at rung r: (value, chosen clusters) of the cluster that ends here."""
        top, fell, kids, first = r, {}, [], r
        while True:
            first = r
            inner = [g for g in parts(members, r - 1)] if r else []
            big = [g for g in inner if len(g) >= min_size]
            if len(big) == 1:
                fell.update(dict.fromkeys(members - big[0], r))
                members, r = big[0], r - 1
                continue
            fell.update(dict.fromkeys(members, r))
            kids = [solve(g, r - 1) for g in big]
            return fell, first, kids, top

    def value(node, end):
        fell, first, kids, _ = node
        own = sum(rate[j] for j in fell.values()) - len(fell) * end
        inner = [value(k, rate[first]) for k in kids]
        worth = sum(x for x, _ in inner)
        return (own, [node]) if not kids or own >= worth else (worth, [c for _, cs in inner for c in cs])

    def joins(node):
        fell, _, kids, _ = node
        out = dict(fell)
        for k in kids:
            out.update(joins(k))
        return out

    for g in parts(range(n), len(radii) - 1):
        if len(g) >= min_size:
            for c in value(solve(g, len(radii) - 1), rate[-1])[1]:
                at = joins(c)
                for p, j in at.items():
                    label[p], prob[p] = min(at), min(1.0, rate[j] / rate[c[1]])
    return [(i, label.get(i, -1), round(prob.get(i, 0.0), 9), i not in label) for i in range(n)]


def frame(spark, v, extra=()):
    return spark.createDataFrame([(i, x.tolist(), "g") for i, x in enumerate(v)] + list(extra), "id long, embedding array<double>, g string")


def test_hierarchical_clusters_equal_brute_force(spark):
    v, radii = blobs(), [0.2, 0.4, 0.6, 0.9, 1.4, 2.2, 4.0]
    got = density.hierarchical_clusters(frame(spark, v), radii, min_size=15, min_samples=5, most=100).collect()
    want = brute(v, radii, 15, 5)
    assert sorted((r.id, r.cluster_id, round(r.cluster_prob, 9), r.is_noise) for r in got) == want
    sizes = {c: sum(w[1] == c for w in want) for c in {w[1] for w in want}}
    assert len(sizes) >= 6 and sizes[-1] > 20 and {0.0, 1.0} < {w[2] for w in want}


def test_groups_on_their_own_and_odd_vectors(spark):
    v, radii = blobs(1)[:250], [0.5, 1.0, 2.0]
    halves = [[(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v) if i % 2 == h] for h in (0, 1)]
    odd = [(900, None, "a"), (901, [1.0, None, 2.0], "a"), (902, [float("nan"), 0.0, 0.0], "b"), (903, [], "b"), (904, [1.0], "a"), (905, [0.0, 0.0, 0.0], "few")]
    df = spark.createDataFrame(halves[0] + halves[1] + odd, "id long, embedding array<double>, g string")
    got = {r.id: (r.g, r.cluster_id, round(r.cluster_prob, 9)) for r in density.hierarchical_clusters(df, radii, 12, 4, within=("g",), least_rows=5).collect()}
    for h, name in enumerate("ab"):
        ids = [i for i, _, _ in halves[h]]
        for k, c, p, _ in brute(v[ids], radii, 12, 4):
            assert got[ids[k]] == (name, ids[c] if c >= 0 else -1, p)
    assert all(got[i][1] == -1 for i in range(900, 906)) and len(got) == 256
    assert density.hierarchical_clusters(df.limit(0), radii, 12, 4).count() == 0


def test_cells_are_bounded_and_prune(spark):
    v = blobs(2)
    cells = metric.dealt(metric.prepared(frame(spark, np.unique(v, axis=0)), "id", "embedding"), 30)
    tree = metric.centres(cells)
    assert max(r["count"] for r in cells.groupBy("cell").count().collect()) <= 30
    assert metric.compared_share(tree, metric.touching(tree, 0.5)) < 0.25


def test_rungs_decide_by_exact_distances():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(1000, 3, (60, 5)), rng.integers(0, 4, (60, 5)), np.full((3, 5), 0.1)])
    radii = [0.5, 1.0, 2.0, 3.0, float(np.sqrt(10))]
    want = np.searchsorted(np.array(radii), np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), side="left")
    assert (metric.rungs(x, x, radii) == np.where(want == len(radii), metric.NEVER, want)).all()


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 25))
        m = rng.integers(0, 5, (n, n)).astype(np.uint8)
        m = np.minimum(m, m.T)
        m[m == 4] = density.NEVER
        edges = density.spanning_forest(m, 4)
        for r in range(4):  # the same components at every rung
            names = [list(range(n)), list(range(n))]
            for which, pairs in enumerate(([(i, j) for i in range(n) for j in range(n) if m[i, j] <= r], [e for e in edges if m[e] <= r])):
                for i, j in pairs:
                    a, b = names[which][i], names[which][j]
                    names[which] = [min(a, b) if x in (a, b) else x for x in names[which]]
            assert names[0] == names[1]


def test_dense_blocks_are_not_squared(monkeypatch):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(0, 0.3, (6000, 3)), [[9.0, 9.0, 9.0]]])
    done, rungs = [0], metric.rungs
    monkeypatch.setattr(metric, "rungs", lambda x, y, r: done.__setitem__(0, done[0] + len(x) * len(y)) or rungs(x, y, r))
    parts = metric.blocks(v, np.arange(len(v)))
    assert sorted(np.concatenate([b.rows for b in parts]).tolist()) == list(range(len(v))) and max(len(b.rows) for b in parts) <= 1024
    near = metric.block_pairs(parts, parts)
    up = np.arange(len(v))
    edges = density.link(v, up, np.ones(len(v), bool), parts, parts, near, 3.0)
    assert len(edges) == 5999 and len(np.unique(density.roots(up, np.arange(len(v))))) == 2
    n = density.counts(v, np.ones(len(v), np.int64), np.arange(len(v)), np.arange(len(v)), [3.0], 6)
    assert (n[0] == 6).sum() == 6000 and n[0][-1] == 1
    assert done[0] < len(v) ** 2 * 0.7  # both steps; before, each compared all pairs


def test_counts_and_whole_rungs_equal_brute_force():
    rng = np.random.default_rng(10)
    v, w = rng.integers(0, 30, (2500, 4)).astype(float), rng.integers(1, 3, 2500)
    radii = [float(np.sqrt(3)), 4.0, 7.5]
    d = metric.distances(v, v)
    assert (metric.rungs(v, v, radii) == np.where(d <= radii[0], 0, np.where(d <= radii[1], 1, np.where(d <= radii[2], 2, metric.NEVER)))).all()
    ask, of = np.arange(0, 2500, 2), np.arange(1, 2500, 2)
    got = density.counts(v, w, ask, of, radii, 9)
    want = np.stack([np.minimum((d[np.ix_(ask, of)] <= r) @ w[of], 9) for r in radii])
    assert (got[0] == want[0]).all() and (got[:, want[0] < 9] == want[:, want[0] < 9]).all()


def test_letter_profiles_count_ascii_letters_of_any_text(spark, tmp_path):
    """Each letter is looked for in what the ones before it leave, not in the whole text 26 times."""
    from threadline.plans.inputs import BY_USE, LETTERS, letter_counts, letter_profiles

    texts = {1: "The Quick brown fox", 2: None, 3: "", 4: "İstanbul Kelvin K ſ é ÀÉa", 5: "zZz" * 400, 6: " \n\t", 7: "日本 é E", 8: "a b c d" * 9}
    assert sorted(BY_USE) == list(LETTERS)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["id"]: list(r["embedding"]) for r in letter_profiles(spark, str(tmp_path)).collect()}
    assert got == {k: [float(1000 * sum(x in (c, c.upper()) for x in t or "") // max(len(t or ""), 1)) for c in LETTERS] for k, t in texts.items()}
    one = spark.createDataFrame([("abca cab",)], "t string").select(letter_counts("t").alias("n")).first()["n"]
    assert {c: n for c, n in zip(BY_USE, one, strict=True) if n} == {"a": 3, "b": 2, "c": 2}


def test_vectors_ask_single_cells_and_no_pair_of_cells_meets(spark, monkeypatch):
    """Only vectors that lack neighbours or lie apart ask other cells, and only cells whose boxes are near; the result is that of all pairs."""
    rng = np.random.default_rng(8)
    far = [rng.normal((x, y, 0, 0), (0.6, 0.3, 0.3, 0.3), (150, 4)) for x, y in ((0, 0), (14, 0), (0, 17), (13, 16))]
    v, radii = np.concatenate([*far, rng.uniform(-5, 20, (60, 4))]).round(3), [0.4, 0.8, 1.6, 3.0]
    monkeypatch.setattr(metric, "each_pair", lambda *a: (_ for _ in ()).throw(AssertionError("cells meet in pairs")))
    monkeypatch.setattr(density, "SAMPLED", 40, raising=False)
    made, was = {}, density.written

    def written(df, name, *a, **k):
        out = was(df, name, *a, **k)
        if name == "asks":
            made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(density, "written", written)
    got = density.hierarchical_clusters(frame(spark, v), radii, min_size=12, min_samples=5, most=60).collect()
    assert sorted((r.id, r.cluster_id, round(r.cluster_prob, 9), r.is_noise) for r in got) == brute(v, radii, 12, 5)
    assert len(made["asks"]) == 2 and max(made["asks"]) < 4 * len(v)  # over 20 cells


def test_boxes_bound_distances_and_counts_beside_are_exact():
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(0, 9, (900, 6)) * [9, 4, 1, 1, 0.5, 0.1], rng.normal(1e7, 1e-3, (100, 6))])
    axes = {6: np.linalg.qr(rng.normal(size=(6, 6)))[0][:, :4]}
    for of in ({}, axes):
        parts = metric.blocks(v, np.arange(500, 1000), 64)
        gaps = metric.box_gaps(v[:500], of, *density.boxed(v, parts, of))
        d = metric.distances(v[:500], v)
        assert all((gaps[:, j] <= d[:, b.rows].min(axis=1)).all() for j, b in enumerate(parts)) and gaps.max() > 50
    w, radii, limit = rng.integers(1, 4, 1000), [12.0, 18.0, 30.0], 7
    upto = rng.integers(0, 3, 500)
    got = density.counts_beside(v, w, 500, upto, radii, limit, axes)
    want = np.stack([np.minimum((d[:, 500:] <= r) @ w[500:], limit) for r in radii])
    first = lambda n: [next((r for r in range(u + 1) if n[r, i] >= limit), None) for i, u in enumerate(upto)]
    assert first(got) == first(want) and len(set(first(want))) == 4
    assert all((got[: (upto[i] if f is None else f - 1) + 1, i] == want[: (upto[i] if f is None else f - 1) + 1, i]).all() for i, f in enumerate(first(want)))
