"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from threadline.llm import bwtdedup, rpforest, simhash
from threadline.llm.common import connected_components


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (50, None), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def plain_fingerprint(text, k=3):
    w = text.encode().lower().split() if text.isascii() else simhash.words_of(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    random.seed(1)
    base = [" ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(60)) for _ in range(5)]
    docs = [(i, b) for i, b in enumerate(base)] + [(10 + i, b + " z") for i, b in enumerate(base)] + [(20, None), (21, " \t"), (22, "one two"), (None, base[0]), (0, base[0])]
    got = simhash.near_duplicates(spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, fp string")).collect()
    fps = [(d, np.uint64(plain_fingerprint(t or ""))) for d, t in docs]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{int(f):016x}") for d, f in fps)
    root = list(range(len(fps)))
    for _ in fps:
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if int(a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    names = {r: min((fps[i][0] for i in range(len(fps)) if root[i] == r and fps[i][0] is not None), default=None) for r in root}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(d), str(names[root[i]])) for i, (d, _) in enumerate(fps))


def test_bk_tree_and_crowded_shards(monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(400)], np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    pairs = {(j, i) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    assert {(int(q), int(n)) for a, b in simhash.BKTree(fps).links(3) for q, n in zip(a, b, strict=True)} == pairs
    whole = simhash.shard_edges(fps, 3, [(s, 3) for s in range(0, 63, 3)] + [(63, 1)])
    monkeypatch.setattr(simhash, "SHARD_NODES", 16)
    cut = simhash.shard_edges(fps, 3, [(s, 3) for s in range(0, 63, 3)] + [(63, 1)])
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]


def brute_spans(docs, n=100):
    """doc_id -> (bytes, removed, runs, digest) by the definition."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("rows", [8192, 2])
def test_suffix_dedup(spark, monkeypatch, rows):
    monkeypatch.setattr(bwtdedup, "GROUP_ROWS", rows)
    random.seed(5)
    word = lambda: "".join(random.choice("abcdeé ") for _ in range(random.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(40), text(80)
    docs = [(1, text(30) + shared + text(20)), (2, shared), (3, text(9) + shared[5:] + text(3)), (4, long), (5, long), (6, long[: len(long) // 2] + "X" + long[len(long) // 2 :]), (7, None), (8, "ab" * 400), (9, "q" * 99), (10, "q" * 100), (11, "q" * 101), (None, shared + "!"), (12, ""), (13, text(30000) + shared)]
    got = bwtdedup.cleaned(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_spans int")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_spans(docs)


def test_suffix_dedup_repeated_rows_and_empty(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(50)) + "".join(chr(97 + i * i % 26) for i in range(90))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (2, t + "!")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in bwtdedup.cleaned(df).collect())
    assert got[:2] == [(1, 140, 0), (1, 140, 0)] and {g[2] for g in got[2:]} == {140}
    assert bwtdedup.cleaned(df.limit(0)).count() == 0
    odd = df.selectExpr("doc_id", "text", "'a' as _doc", "'b' as _ver", "'c' as doc", "'d' as kept", "'e' as _keep")
    got = bwtdedup.cleaned(odd).collect()
    assert len(got) == 4 and {(r._doc, r._ver, r.doc, r._keep) for r in got} == {("a", "b", "c", "e")} and {r.n_removed for r in got} == {0, 140}


def test_merge_orders_all_suffixes():
    random.seed(3)
    for _ in range(40):
        texts = [bytes(random.choice(b"ab") for _ in range(random.randint(12, 40))) for _ in range(random.randint(2, 7))]
        who, off, common, left = bwtdedup.merge_shards(texts, np.arange(len(texts)) % 3, 12)
        keys = [texts[w][o : o + 12] for w, o in zip(who, off, strict=True)]
        assert keys == sorted(keys) and len(keys) == sum(map(len, texts))
        assert [bool(c >= 12) for c in common[1:]] == [a == b and len(a) == 12 for a, b in zip(keys, keys[1:], strict=False)]


def test_forest(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "LEAF", 40)
    monkeypatch.setattr(rpforest, "LEAF_MAX", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[:60] + rng.normal(size=(60, 16)) * 0.08
    x[200:230] = x[5]
    vecs = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0, 2.0]), (1005, []), (None, vecs[0][1])]
    got = rpforest.near_duplicates(spark.createDataFrame(vecs + odd, "vec_id long, embedding array<float>")).collect()
    u = np.array([v for _, v in vecs] + [vecs[0][1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    by = {r.vec_id: r for r in got}
    assert len(got) == 307 and all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(1000, 1006))
    links = near.sum(axis=1) - 1
    assert all(by[i].n_links <= links[i] for i in range(300))
    found, real = sum(by[i].n_links for i in range(300)), int(links[:300].sum())
    assert 0.97 * real <= found <= real
    assert by[210].component_id == 5 and not by[210].kept
    assert rpforest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_forest_counts_each_link_once(spark, monkeypatch):
    """A dense group that lies in many leaves and in several blocks, vectors in double precision, names that clash."""
    monkeypatch.setattr(rpforest, "LEAF", 30)
    monkeypatch.setattr(rpforest, "LEAF_MAX", 50)
    rng = np.random.default_rng(9)
    c = rng.normal(size=8)
    x = np.concatenate((c + rng.normal(size=(180, 8)) * 0.12, rng.normal(size=(200, 8))))
    df = spark.createDataFrame([(i, [float(v) for v in r], "x", 1, 2) for i, r in enumerate(x)], "vec_id long, embedding array<double>, gid string, key int, leaf int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    got = {r.vec_id: r for r in rpforest.near_duplicates(df).collect()}
    links = near.sum(axis=1) - 1
    assert all(got[i].n_links <= links[i] for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.95 * links.sum() and links.sum() > 5000


def test_forest_recall_at_depth():
    """Pairs at a cosine of exactly 0.95 share a leaf nearly always, also in trees much deeper than the sample can fit."""
    rng = np.random.default_rng(7)
    x = rpforest.unit(rng.normal(size=(9192, 64)) + 2 * rng.normal(size=(12, 64))[rng.integers(0, 12, 9192)])
    q, s = x[:1000], x[1000:]
    z = rng.normal(size=q.shape)
    z = rpforest.unit(z - (z * q).sum(axis=1, keepdims=True) * q)
    other = 0.95 * q + np.sqrt(1 - 0.95**2) * z
    for n in (50_000, 10_000_000, 1_000_000_000):
        forest = rpforest.fit_forest(s, n, rpforest.LEAF, rpforest.spill_of(64))
        mine, its = (set(zip(*(c.tolist() for c in rpforest.route(v, forest, rpforest.spill_of(64))), strict=True)) for v in (q, other))
        assert len({row for row, _ in mine & its}) >= 950 and len(mine) <= 100 * len(q)


def test_spanning_roots_agree():
    rng = np.random.default_rng(3)
    for square in (True, False):
        m = rng.random((60, 60 if square else 45)) < 0.02
        if square:
            m = m | m.T
        listed = rpforest.spanning(m)
        most, rpforest.LISTED_LINKS = rpforest.LISTED_LINKS, -1
        assert (rpforest.spanning(m) == listed).all()
        rpforest.LISTED_LINKS = most


@pytest.mark.parametrize("length", [30, 31, 32, 100])
def test_repeats_of_just_the_length_are_found(length):
    """Whatever the length: symbols a round divide it, so that agreeing so far is told from agreeing less."""
    random.seed(length)
    text = lambda n: bytes(random.randrange(97, 123) for _ in range(n))
    same = text(length)
    texts = [b"<" + same + b">" + text(20), text(9) + b"[" + same + b"]", b"{" + same[1:] + b"}" + text(40)]
    got = bwtdedup.repeated_windows(texts, np.arange(3), np.zeros(3, np.int64), np.zeros(3, np.int64), length)
    assert got == [(1, 0, 10, length)]
