"""Edge cases that the other tests leave out: empty tables, very long texts, ties, clashing columns; the risk that toxicity's fit follows."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from threadline.llm import nnpu, simhash, spviterbi, urlfilter


def test_simhash_of_empty_tables_and_long_texts(spark):
    schema = "doc_id long, text string, node string, fingerprint string"
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, long), (2, long + " more"), (3, long), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (7, "one two")]
    d = spark.createDataFrame([(*r, "n", "f") for r in rows], schema)
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    got = simhash.near_duplicates(d).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[7] == 7 and len(got) == len(rows)
    assert {r.fingerprint for r in got if r.doc_id in (4, 5, 6)} == {"0" * 16}


def test_url_ties_and_odd_urls(spark):
    when = "2024-01-05"
    cap = spark.createDataFrame([(1, "http://x.bad.com/a", when), (2, "", when), (3, "http://" + "a." * 3000 + "bad.com/" + "p" * 100_000, when), (1, "http://x.bad.com/a", when)], "id int, url string, d string").selectExpr("id", "url", "cast(d as timestamp) fetched")
    both = [("l", "bad.com", "2024-01-02", "add"), ("l", "bad.com", "2024-01-02", "remove")]
    ch = spark.createDataFrame(both, "list_name string, pattern string, e string, action string").selectExpr("list_name", "pattern", "cast(e as timestamp) effective", "action")
    assert {(r.id, r.blocked) for r in urlfilter.judge(cap, ch).collect()} == {(1, False), (2, False), (3, False)}  # remove wins at one instant
    added = {r.id: r.blocked for r in urlfilter.judge(cap, ch.filter("action = 'add'")).collect()}
    assert added[1] and added[3] and not added[2]


def test_last_stage_keeps_clashing_columns_apart(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_pieces string, _c string"
    d = spark.createDataFrame([(1, "a word", "en", "s", 6, "i", "n", "c"), (1, "a word", "en", "s", 6, "i", "n", "c"), (None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "i", "n", "c")], schema)
    got = corpus_pipeline.sentencepiece(spark, d, "")
    assert got.columns == ["doc_id", "lang", "source", "n_pieces", "ids_crc32", "exact", "ids"]
    rows = got.collect()
    assert sorted((r.doc_id or 0, r.n_pieces > 0, r.exact) for r in rows) == [(0, False, True), (1, True, True), (1, True, True), (2, False, True)]
    assert all(r.n_pieces == len(r.ids) for r in rows)
    assert corpus_pipeline.sentencepiece(spark, d.limit(0), "").count() == 0


def test_pieces_of_a_very_long_word(spark):
    word = "ab" * 60_000
    got = spark.createDataFrame([(1, word)], "doc_id long, text string").select(spviterbi.encode_and_check(F.col("text"), spviterbi.default_model()).alias("c")).first().c
    assert got.exact and got.n_pieces == len(got.ids) > 1000


def test_nnpu_fit_follows_its_risk():
    """The fit against plain steps whose gradients are differences of the risk itself."""
    rng = np.random.default_rng(4)
    x = (rng.random((14, 5)) < 0.4).astype(float)
    positive = np.array([True] * 5 + [False] * 9)
    prior, rate, l2 = 0.6, 0.2, 1e-4

    def parts(t):
        z = x @ t[:-1] + t[-1]
        lose_pos, lose_neg = np.logaddexp(0, -z), np.logaddexp(0, z)
        return prior * lose_pos[positive].mean(), lose_neg[~positive].mean() - prior * lose_neg[positive].mean()

    theta, m, v = np.zeros(6), np.zeros(6), np.zeros(6)
    theta[-1] = np.log(prior / (1 - prior))
    turned = 0
    for step in range(1, 61):
        below = parts(theta)[1] < 0
        turned += below
        risk = lambda t, below=below: -parts(t)[1] if below else sum(parts(t))
        g = np.array([(risk(theta + e) - risk(theta - e)) / 2e-6 for e in np.eye(6) * 1e-6])
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, bias = nnpu.fit_nnpu(*np.nonzero(x), positive, 5, prior, steps=60, rate=rate, l2=l2)
    assert np.allclose(np.append(w, bias), theta, atol=1e-3) and 0 < turned < 60


def test_toxicity_without_anything_to_learn(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None), (None, "x")], "doc_id long, text string")
    l = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    learn = F.lit(True)
    for docs, labels in ((d.limit(0), l), (d, l.limit(0)), (d.limit(0), l.limit(0))):
        scored = nnpu.score(d, nnpu.train(docs, labels, learn)).collect()
        assert len(scored) == 3 and all(0 <= r.score <= 1 for r in scored)
    assert nnpu.score(d.limit(0), nnpu.train(d, l, learn)).count() == 0
