"""Encoding, scoring, classification and decontamination against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.llm import nnpu, pst, spviterbi, winnow


def test_viterbi(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    v = spviterbi.Viterbi(path)
    score = {v.pieces[int(i)]: s for i, s in zip(v.ids, v.scores, strict=True)}
    number = {v.pieces[int(i)]: int(i) for i in v.ids}

    def plain(t):
        w = " " + t.replace("▁", " ") if t else ""
        best = [(0.0, [])]
        for e in range(1, len(w) + 1):
            top = None
            for k in range(min(e, v.longest), 0, -1):
                s = score.get(w[e - k : e], v.unk_score if k == 1 else None)
                if s is not None and (top is None or best[e - k][0] + s > top[0]):
                    top = (best[e - k][0] + s, [*best[e - k][1], w[e - k : e]])
            best.append(top)
        return [i for x in best[-1][1] for i in ([number[x]] if x in number else [int(v.byte_ids[b]) for b in x.encode()])]

    random.seed(8)
    texts = ["Hello  world, the the.", "", None, " x ", "日本語 ﬁ \n\t é", "a" * 300, "1/2 <s> </s> ünï", "  ", "▁a▁▁b", "Hello  world, the the.", "x" * 2500 + " " + "ab" * 300]
    texts += ["".join(random.choice("abcé日😀 the") for _ in range(n)) for n in (3, 41, 60, 900)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, ids int")
    enc = {r.doc_id: list(r.ids) for r in spviterbi.encode_documents(df, path).collect()}
    assert enc == {i: plain(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.exact for r in spviterbi.encoded_and_back(df, path).collect()} == {i: "▁" not in (t or "") for i, t in enumerate(texts)}
    long = "a few words " * 50_000  # the ids of a very long text are those of its words
    ids, n = v.encode([long, "a few words a few words"])
    assert n[0] - 1 == (n[1] // 2) * 50_000 and v.decode(ids, n) == [long, "a few words a few words"]
    assert spviterbi.encode_documents(df.limit(0), path).count() == 0 and spviterbi.encoded_and_back(df.limit(0), path).count() == 0
    odd = spark.createDataFrame([(1, [None, -1, 10**6, 1, number[" x"]]), (2, None), (3, []), (4, [number["x"], number[" x"]])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in spviterbi.decode_documents(odd, path).collect()} == {1: "x", 2: "", 3: "", 4: "x x"}


def test_viterbi_solves_long_parts_alike(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    v = spviterbi.Viterbi(P.path("piece_bpe_32k.model"))
    random.seed(9)
    texts = ["".join(random.choice("abcdethinrs日") for _ in range(n)) for n in range(1, 120, 7)]
    want = [x.tolist() for x in v.encode(texts)]
    for even, long, run in ((40, 10, 1 << 18), (2, 2048, 64)):
        monkeypatch.setattr(spviterbi, "EVEN", even)
        monkeypatch.setattr(spviterbi, "LONG", long)
        monkeypatch.setattr(spviterbi, "SOLVE_CHARS", run)
        assert [x.tolist() for x in v.encode(texts)] == want


def test_language_model(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(random.choice(words) if random.random() < 0.6 else "see the end" for _ in range(random.randint(0, 60)))) for i in range(200)] + [(200, None), (None, "W1\tnew")]
    got = pst.score(spark.createDataFrame(docs, "doc_id long, text string"), ~pst.held_out()).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    c = Counter(w for i, t in docs if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = {i: (len(tok(t)), sum(c[w] > 0 for w in tok(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t))) for i, t in docs}
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert abs(r.base_score - want[r.doc_id][2]) < 1e-6
    out = [r for r in got if r.doc_id is not None and held(r.doc_id)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_without_rows(spark):
    assert pst.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_decontamination(spark):
    random.seed(7)
    word = lambda: random.choice(["Alpha", "beta", "g4mma", "délta", "eps", "zeta", "eta", "theta"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([25, 10, 9, 3, 1, 0, 40])] + [(7, None), (2, "eta, EPS. zeta")]
    docs = [(i, " ".join(word() for _ in range(60)) + "; " + items[i % 7][1].upper().replace("É", "é") + ". tail") for i in range(14)] + [(20, None), (21, "..."), (22, items[0][1]), (22, items[0][1])]
    got = winnow.contamination(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wins: dict = {}
    for i, t in items:
        w = ws(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    import hashlib

    want = []
    for d, t in docs:
        w, hit, found = ws(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)


def test_decontamination_edges(spark):
    """Empty tables, a very long text, names that clash."""
    docs = spark.createDataFrame([(1, "A b c " * 60_000 + "one two three", 7, "x"), (2, "x " * 9 + "y", 8, "y"), (3, None, 9, "z")], "doc_id long, text string, win int, start string")
    bench = spark.createDataFrame([(1, "two THREE"), (2, "x x x x x x x x x y"), (3, None), (None, "b c a")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated, r.win, r.start) for r in winnow.contamination(docs, bench).collect()}
    assert got == {1: (180003, 179999, 1, True, 7, "x"), 2: (10, 10, 1, True, 8, "y"), 3: (0, 0, 0, False, 9, "z")}
    assert winnow.contamination(docs.limit(0), bench).count() == 0
    assert {(r.n_hit, r.contaminated) for r in winnow.contamination(docs, bench.limit(0)).collect()} == {(0, False)}


def test_words_are_counted_and_lowered_as_defined(spark):
    """Counts without matching a pattern word by word; only A-Z are lower-cased, in ASCII texts and others."""
    rows = ["", " ", "a", " a", "a ", ",A-b,,C9 ", "\u00c9T\u00c9 \u00c9t\u00e9 ABC", "K \u212a", "\x7fx\x00y", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    ws = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in rows]
    got = d.select(winnow.words(F.col("t")).alias("w"), winnow.word_count(F.coalesce("t", F.lit(""))).alias("n"))
    assert [(r.w, r.n) for r in got.collect()] == [(w, len(w)) for w in ws]
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_winnowing_is_native(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert "Python" not in winnow.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()


def test_toxicity(spark):
    random.seed(3)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "te") for b in ("na", "ru", "lo", "shi", "po")]
    docs, labels = [], []
    for i in range(900):
        bad = i % 8 == 0
        t = [random.choice(plain) for _ in range(20)] + (["zargoth"] if bad else [])
        docs.append((i, " ".join(t)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs += [(5000, None), (5001, ""), (None, "zargoth")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = nnpu.train(d, l, nnpu.fold("doc_id", 3) != 1)
    out = {r.doc_id: r for r in nnpu.score(d.withColumn("score", F.lit("x")), model).collect()}
    assert all(out[i].predicted == (i % 8 == 0) for i in range(900)) and out[5000].predicted == 0 and out[5001].score == out[5000].score and out[None].predicted == 1
    none = nnpu.train(d, l.filter("toxic = 0"), nnpu.fold("doc_id", 3) != 1)
    assert {r.score for r in nnpu.score(d, none).collect()} == {0.0} and nnpu.score(d.limit(0), model).count() == 0


def test_scores_are_those_of_their_own_model(spark):
    """Workers are reused: what one remembers of a model must not serve another."""
    d = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "alpha " * 50_000), (3, "beta" * 3000)], "doc_id long, text string")
    for _ in range(3):
        for weights in ({"=alpha": 4.0}, {"=beta": 4.0, "^bet": -9.0}, {"=alpha": -4.0}):
            got = {(r.doc_id, round(r.score, 9)) for r in nnpu.score(d, {"weights": weights, "bias": 0.5}).collect()}
            z = {1: sum(w for f, w in weights.items() if f in nnpu.text_features("alpha beta")), 2: weights.get("=alpha", 0.0), 3: weights.get("^bet", 0.0)}
            assert got == {(i, round(1 / (1 + math.exp(-0.5 - x)), 9)) for i, x in z.items()}


def test_nnpu_risk_learns_from_unlabelled():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    positive = y & (rng.random(3000) < 0.4)
    rows, cols = np.nonzero(np.stack([y, rng.random(3000) < 0.5], axis=1))
    w, b = nnpu.fit_nnpu(rows, cols, positive, 2, 0.3)
    assert w[0] + b > 0 > b and abs(w[1]) < abs(w[0]) / 2


def plain_tree(docs, held, depth=3):
    """Scores by the definition: every context seen five times can be kept, every successor seen twice is listed."""
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    train = [tok(t) for i, t in docs if not held(i)]
    one = Counter(w for ws in train for w in ws)
    n_all, once, twice = sum(one.values()), sum(n == 1 for n in one.values()), sum(n == 2 for n in one.values())
    discount = min(0.95, max(0.05, once / (once + 2 * twice)))
    grams: dict = {}
    for ws in train:
        ws = [None, *ws]
        for i in range(1, len(ws)):
            for d in range(1, min(depth, i) + 1):
                grams.setdefault(tuple(ws[i - d : i]), Counter())[ws[i]] += 1
    root = lambda x: (one[x] - discount) / n_all if one[x] else discount * len(one) / n_all
    total = {c: sum(s.values()) for c, s in grams.items()}
    kept = set()
    for c, s in grams.items():
        if total[c] >= 5 and any(n > 1 for n in s.values()):
            up = lambda x, c=c: grams[c[1:]][x] / total[c[1:]] if len(c) > 1 else root(x)
            if sum(n * math.log(n / total[c] / up(x)) for x, n in s.items() if n > 1) > 0.5 * len(s) * math.log(total[c]):
                kept |= {c[i:] for i in range(len(c))}

    def p(c, x):
        if not c:
            return root(x)
        if c not in kept:
            return p(c[1:], x)
        s = {y: n for y, n in grams[c].items() if n > 1}
        return (s.get(x, 0) + (20 + total[c] - sum(s.values())) * p(c[1:], x)) / (total[c] + 20)

    for c in list(kept)[:50]:
        assert abs(sum(p(c, x) for x in one) + p(c, "never seen") - 1) < 1e-9
    assert {len(c) for c in kept} == {1, 2, 3}
    return {i: sum(math.log10(p(tuple(ws[max(0, k - depth) : k]), ws[k])) for k in range(1, len(ws))) for i, t in docs for ws in [[None, *tok(t)]]}


@pytest.mark.parametrize(("share", "context", "run"), [(1e-5, 1e-4, 1 << 24), (0.01, 0.01, 2000), (2.0, 2.0, 300)])
def test_language_model_is_whole(spark, monkeypatch, share, context, run):
    """All successors and contexts count, however small their share; entries of the table and common ones score alike, and so do contexts dealt whole or by pairs."""
    monkeypatch.setattr(pst, "HOT_SHARE", share)
    monkeypatch.setattr(pst, "BROADCAST_SHARE", share)
    monkeypatch.setattr(pst, "HOT_CONTEXT", context)
    monkeypatch.setattr(pst, "COUNT_RUN", run)
    monkeypatch.setattr(pst, "SCORE_RUN", run)
    monkeypatch.setattr(pst, "FILTER_BITS", 9 if run == 300 else 27)  # the small filter lets nearly all through
    monkeypatch.setattr(pst, "PART_BITS", 6 if run == 300 else 18)
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    phrases = [" ".join(random.choice(words) for _ in range(5)) for _ in range(60)]
    docs = [(i, " ".join(random.choice(phrases) if random.random() < 0.5 else random.choice(words) for _ in range(random.randint(0, 50)))) for i in range(300)] + [(300, None), (301, "new words"), (302, phrases[0] + (" " + phrases[1]) * 3000), (303, "ü Ü\u00a0x\u2003 W1")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = plain_tree(docs, held)
    got = {r.doc_id: r.score for r in pst.score(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string"), ~pst.held_out()).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_language_model_keeps_rare_contexts(spark):
    """Eight occurrences are a context, though they hold far less than a fifty-thousandth of a large corpus."""
    random.seed(6)
    docs = [(i, " ".join(random.choices(["w%d" % k for k in range(40)], k=150))) for i in range(3000)]
    docs += [(3000 + i, "zq zr zs " * 2) for i in range(4)] + [(9001, "zq zr zs"), (9002, "zs zr zq")]
    got = {r.doc_id: r.score for r in pst.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 9000).collect()}
    assert got[9001] > got[9002] + 1
