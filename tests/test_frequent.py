from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.operators import terms as W
from threadline.operators import topics as O


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(5)
    words = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    share = 1 / np.arange(1, 121)
    rows = [(i, [None, "a", "b", "small"][0 if i == 7 else 3 if i % 50 == 3 else 1 + i % 2], " ".join(rng.choice(words, rng.integers(0, 40), p=share / share.sum()))) for i in range(300)]
    rows += [(1000, "a", None), (1001, "b", ""), (1002, "one", "lonely words"), (7, "a", "qaa qaa qaa qaa")]
    return spark.createDataFrame(rows, "id long, c string, text string")


@pytest.fixture
def kept(monkeypatch):
    """The tables written on the way, by name."""
    got = {}

    def keep(df, name, *args, written=W.written, **options):
        out = written(df, name, *args, **options)
        got.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(W, "written", keep)
    return got


def test_frequent_ngrams_are_exact(posts, monkeypatch):
    monkeypatch.setattr(W, "FIRST_WORDS", 4)  # too few at first
    for n, k in ((2, 15), (3, 10), (3, 100_000)):
        want = W.term_counts(posts, n=n).orderBy(F.desc("n"), "term").limit(k).collect()
        assert W.top_terms(posts, n, k).select("term", "n").collect() == want and want
    assert W.top_terms(posts.limit(0), 3, 5).count() == 0


def test_rare_ngrams_are_not_counted(posts, kept, monkeypatch):
    monkeypatch.setattr(W, "FIRST_WORDS", 20)
    pairs = []
    monkeypatch.setattr(W, "grams_among", lambda df, good, n, keep=(), f=W.grams_among: pairs.append(good.count()) or f(df, good, n, keep))
    W.top_terms(posts, 2, 3).collect()
    assert pairs and max(pairs) < posts.select(F.explode(W.words_of(posts)).alias("t")).distinct().count()


def test_cluster_keywords_keep_the_vocabulary_only(posts, kept):
    got = {(r.c, r.term): r.weight for r in W.cluster_keywords(posts, "c", "id", k=1000, vocabulary=30).collect()}
    docs, texts = {}, {}
    for r in posts.filter("c is not null").collect():
        texts.setdefault((r.c, r.id), []).append(r.text or "")
    for (c, i), t in texts.items():
        tf = Counter()
        for x in t:
            w = x.split()
            tf.update(w + [f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)])
        docs.setdefault(c, {})[i] = tf
    want = {}
    for c, d in docs.items():
        f, df = Counter(), Counter()
        for tf in d.values():
            f.update(tf)
            df.update(tf.keys())
        top = sorted(f, key=lambda t: (-f[t], t))[:30]
        for tf in d.values():
            w = {t: tf[t] * (np.log((1 + len(d)) / (1 + df[t])) + 1) for t in top if t in tf}
            for t, x in w.items():
                want[c, t] = want.get((c, t), 0) + x / np.sqrt(sum(y * y for y in w.values())) / len(d)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert kept["tf"][0].select("c", "term").distinct().count() == len(want)  # other terms are counted, but not by document


def test_weightiest_terms_are_those_of_all(posts, kept):
    p = posts.filter("c is not null")
    d = p.select("c", W.words_of(p).alias("words"))
    for k, least in ((5, 2), (30, 1), (10_000, 2)):
        rows = [[(r.c, r.term, r["rank"], round(r.weight, 12)) for r in t.collect()] for t in (W.top_class_terms(d, "c", k, min_df=least), W.top_per(W.class_tfidf(p, "c", min_df=least, grams=(1, 2)), "c", "weight", k))]
        assert sorted(rows[0]) == sorted(rows[1]) and any(" " in r[1] for r in rows[0])
    pairs = p.select("c", F.explode(W.ngrams(W.words_of(p), 2)).alias("t")).distinct().count()
    assert kept["tf"][1].count() < pairs / 2  # of k = 5


def test_topics_cut_texts_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(W, "terms", lambda *a, f=W.terms: calls.append(1) or f(*a))
    words = ["apple banana cherry grape", "engine wheel motor brake"]
    docs, said = O.fit_topics(spark.createDataFrame([(i, words[i % 2]) for i in range(60)], "id long, text string"), 0.2, n_topics=1, rerank=True, reduce_to=2)
    assert docs.columns == ["topic_id", "id", "text", "topic_prob", "topic_label"] and docs.count() == 60 and said.count() and len(calls) == 1
