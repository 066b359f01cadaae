"""The BK-trees of near-dedup's shards against all pairs."""

import numpy as np
import pytest

from threadline.llm import nearsets


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_trees_find_all_pairs_within_the_radius(most):
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 70, 1, 200, 5]
    bits = []
    for n in sizes:  # random fingerprints, near ones of a few of them, and equal ones
        x = rng.integers(0, 2, (n, 256), dtype=np.uint8)
        for i in range(1, n):
            if rng.random() < 0.7:
                x[i] = x[rng.integers(0, min(i, 4))]
                x[i, rng.choice(256, rng.integers(0, 90), replace=False)] ^= 1
        bits.append(x)
    x = np.concatenate(bits)
    words = np.packbits(x, axis=1).view(">i8").astype(np.int64)
    root = np.repeat(np.cumsum(sizes) - sizes, sizes)
    forest = nearsets.BKForest([words[:, i] for i in range(4)], root)
    apart = (x[:, None] != x[None]).sum(axis=2)
    near = (apart <= nearsets.RADIUS) & (root[:, None] == root[None]) & np.tri(len(x), k=-1, dtype=bool)
    ok = lambda i, j: (i + j) % 7 != 0
    want = {(i, j) for i, j in zip(*(z.tolist() for z in np.nonzero(near)), strict=True) if (i + j) % 7}
    got = [p for i, j in forest.before(ok, False, most) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(want) and set(got) == want and len(want) > 300
    one = [p for i, j in forest.before(ok, True, most) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(one) <= want and sorted(i for i, _ in one) == sorted({i for i, _ in want})
    if most > 1000:  # edges outside the radius are not followed
        seen = []
        forest.distance = lambda i, j, f=forest.distance: seen.append(len(i)) or f(i, j)
        list(forest.before(ok, False, most))
        assert sum(seen) < sum(n * (n - 1) // 2 for n in sizes)


def test_a_crowd_under_the_similarity_is_not_squared(spark):
    """Texts made from one by different changes: near each other, few at 0.8 or more; their pairs are not all listed, and none that counts is lost."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(200)], []
    for k in range(160):
        w = list(base)
        for at in rng.choice(200, rng.integers(3, 9), replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    for k in range(160, 180):  # close relations of some of them
        rows.append((k, rows[3 * (k - 160)][1] + f" y{k}"))
    h = [set(nearsets.shingles(t, 5).tolist()) for _, t in rows]
    near = [(i, j) for i in range(len(h)) for j in range(i) if len(h[i] & h[j]) >= 0.8 * len(h[i] | h[j])]
    up = list(range(len(h)))
    for i, j in near * len(h):
        up[i] = up[j] = min(up[i], up[j])
    sets = nearsets.with_sets(spark.createDataFrame(rows, "id long, text string"), "id", 5).cache()
    got = {r["id"]: r["root"] for r in nearsets.near_sets(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert len({(up[i], got[i]) for i in up}) == len(set(up)) == len(set(got.values())) and 20 < len(near) < 2000 and len(set(up)) > 50
    rooted = sets.select(*nearsets.NODE, "sk").toDF(*nearsets.NODE, "root")
    found = nearsets.candidates(nearsets.dealt(rooted, nearsets.tables_for(len(rows), 0.8), ["root"]), 0.8, True)
    assert found.count() < 4000  # of 16,110 pairs, most of which are near enough to be candidates
    name = {r["sk"]: r["id"] for r in sets.collect()}
    kept = {tuple(sorted((name[r["a"]], name[r["b"]]), reverse=True)) for r in nearsets.crowd_pairs(sets.withColumn("root", sets["sk"]), 0.8).collect()}
    assert set(near) <= kept and len(kept) < 2 * len(near) + 100
