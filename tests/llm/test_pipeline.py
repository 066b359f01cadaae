"""The stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as C


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    random.seed(11)
    w = [a + b for a in ("ba", "ko", "mi", "te", "su", "ra") for b in ("na", "ru", "lo", "shi", "po", "den")]
    text = lambda n=80: " ".join(random.choice(w) for _ in range(n))
    docs = {i: text() for i in range(400)}
    for i in range(0, 400, 9):
        docs[i] += " zargoth"
    passage, item = text(60), text(30)
    docs[1001], docs[1002] = docs[1], docs[1]
    docs[1003], docs[1004] = text() + " " + passage, text() + " " + passage + " " + text(5)
    docs[1005] = text() + " " + item
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(400) if i % 9}
    assert clean <= set(got) and not {i for i in range(0, 400, 9)} & set(got)
    assert 1 in got and not {1001, 1002, 1005} & set(got)
    assert {1003, 1004} <= set(got) and got[1004].n_pieces < got[1003].n_pieces
    assert all(r.exact for r in got.values()) and C.STAGES[-1][0].startswith("SentencePiece")


def shingle_set(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("small", [64, 1])
def test_near_dedup_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(C.nearsets, "SMALL", small)
    random.seed(12)
    w = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(60):
        base = [random.choice(w) for _ in range(120)]
        texts.append(base)
        for edits in (1, 2, 3, 4, 6):
            copy = list(base)
            for at in random.sample(range(120), edits):
                copy[at] = random.choice(w)
            texts.append(copy)
    rows = [(None if i % 10 == 3 else i // 2 if i % 10 == 7 else i, " ".join(t)) for i, t in enumerate(texts)] + [(None, None), (900, ""), (5, " ".join(texts[5]))]
    sets = [shingle_set(t) for _, t in rows]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups = {r: {(x, t) for (x, t), y in zip(rows, root, strict=True) if y == r} for r in root}
    df = spark.createDataFrame([(x, t, "en") for x, t in rows], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.text) for r in C.near_dedup(spark, df, "").collect()]
    assert len(got) == len(set(got))
    kept = [sum(x in g for x in got) for g in groups.values()]
    assert min(kept) == 1 and len(got) <= len(groups) * 1.02
    for g in groups.values():
        ids = [x for x, _ in g if x is not None]
        assert any(x in g and (not ids or x[0] == min(ids)) for x in got)


def test_near_dedup_of_short_texts_is_exact(spark):
    """Texts of up to 22 words with one to three words off at the ends or within, many of them under one prefix."""
    random.seed(15)
    w = [f"w{i}" for i in range(2000)]
    words = lambda n: [random.choice(w) for _ in range(n)]
    texts = []
    for n in range(1, 20):
        for _ in range(12):
            base = words(n)
            texts += [base, base + words(1), base + words(2), words(1) + base + words(1), base[:-1] + words(1), base + words(3)]
    head = words(10)
    texts += [head + words(1) for _ in range(150)] + [head] + [head[:9] + words(2) for _ in range(20)]
    random.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for _, t in rows]
    small = [len(s) <= C.nearsets.FEW for s in sets]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (small[i] or small[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.root for r in C.nearsets.near_sets(df, "id").collect()}
    together: dict = {}
    for i, r in enumerate(root):
        together.setdefault(r, set()).add(got[i])
    assert all(len(x) == 1 for x in together.values()) and sum(len({i for i in range(len(root)) if root[i] == r}) > 1 for r in together) > 50
    short = [i for i in range(len(rows)) if small[i]]
    assert len({root[i] for i in short}) == len({got[i] for i in short})  # and nothing else is joined


def test_documents_without_an_id_or_with_a_shared_one_stay(spark):
    random.seed(13)
    text = lambda: " ".join(random.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(random.randint(0, 99)) for _ in range(40))
    rows = [(None, text(), "x", 1) for _ in range(5)] + [(7, text(), "y", 2) for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    left = C.suffix_dedup(spark, C.near_dedup(spark, df, ""), "")
    assert sorted((str(r.doc_id), r.text, r.source) for r in left.collect()) == sorted((str(i), t, s) for i, t, s, _ in rows)


def test_stages_keep_columns_that_clash(spark, tmp_path):
    """Names that stages use, nulls in every column, empty and very long texts, repeated rows."""
    random.seed(14)
    text = lambda n=60: " ".join(random.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(random.randint(0, 99)) for _ in range(n))
    names = ["kept", "n_words", "n_hit", "_row", "_doc", "score", "predicted", "_text", "n_removed", "root", "contaminated"]
    shared = text(70)
    texts = [text() for _ in range(30)] + [text(30_000), shared + " " + text(9), text(9) + " " + shared, None, ""]
    rows = [(None if i == 3 else i, t, None if i % 5 else "en", "s", None if t is None else len(t), *[f"{n}{i}" if i % 7 else None for n in names]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(i, int(i % 2)) for i in range(4)], "doc_id long, toxic int").filter("toxic = 0").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "none of these words are in any of the documents here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([*rows, rows[5]], schema)
    extra = {(r[0], *r[5:]) for r in rows}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        got = out.collect()
        assert len(got) == {"toxicity": 36, "simhash near-dedup": 34}.get(name, 36), name
        assert {(r.doc_id, *tuple(r)[5:]) for r in got} <= extra, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    cut = {r.doc_id: r for r in C.suffix_dedup(spark, df, str(tmp_path)).collect()}
    assert len(cut[32].text) < len(texts[32]) == len(texts[32]) and cut[32].n_chars == len(cut[32].text) and cut[30].text == texts[30]
    assert {r.doc_id: r.n_pieces for r in C.sentencepiece(spark, df, "").collect()}[34] == 0
