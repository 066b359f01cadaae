"""Lexical search, token counts and alignment against brute force and the libraries."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from threadline.llm import align, revsearch, tokenfst

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score string, n int, row string, item string, term string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "s", 7, "r", "i", "t") for r in rows], DOCS).repartition(parts)


# --- ranked lexical search -------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(items, docs, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def search_rows():
    rnd = random.Random(5)
    words = ["alpha", "BETA", "gamma9", "Δelta", "été", "x", "of", "the"] + [f"w{i}" for i in range(60)]
    say = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(i, say(rnd.randint(0, 40))) for i in range(300)]
    docs += [(400 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[3][1]), (None, None), (500, ""), (501, "the " * 30000), (502, "…")]
    items = [(i, say(rnd.randint(1, 12))) for i in range(40)] + [(40, None), (41, ""), (42, "nowhere"), (43, "of of of the"), (43, "of of of the"), (None, "alpha beta")]
    return items, docs


@pytest.mark.parametrize("limits", [(), (60, 7, 50, 64)])
def test_search_equals_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK_POSTINGS", "BLOCK_ITEMS", "CELLS", "TOGETHER"), limits, strict=False):
        monkeypatch.setattr(revsearch, name, value)
    items, docs = search_rows()
    i = spark.createDataFrame([(*r, "d", 1) for r in items], "item_id long, text string, doc_id string, rank int")
    got = sorted(map(tuple, revsearch.search(i, frame(spark, docs)).collect()), key=str)
    assert got == ranked(items, docs)
    if limits:
        assert len(revsearch.blocks(revsearch.indexed_items(i, "item_id", "text").coalesce(1))) > 4


def test_search_empty_tables(spark):
    items, docs = search_rows()
    i, d = spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs)
    assert revsearch.search(i.limit(0), d).count() == 0 and revsearch.search(i, d.limit(0)).count() == 0
    assert revsearch.search(i, d.withColumn("text", F.lit(None).cast("string"))).count() == 0
    assert [c for c, _ in revsearch.search(i, d).dtypes] == ["item_id", "rank", "doc_id", "score"]


def test_heaps_keep_the_best_in_any_order():
    rnd = np.random.default_rng(1)
    score, ids = rnd.integers(0, 6, (500, 9)), rnd.permutation(500)
    heaps = revsearch.Heaps(9, 4)
    for s in range(0, 500, 37):
        heaps.push(score[s : s + 37], np.zeros(len(ids[s : s + 37]), bool), ids[s : s + 37])
    want = sorted((i, -v, d) for i in range(9) for v, d in sorted((-int(v), int(d)) for v, d in zip(score[:, i], ids, strict=True) if v)[:4] for v in [v])
    assert sorted((int(i), int(v), int(d)) for i, v, _, d in zip(*heaps.held, strict=True)) == want


# --- token counts ----------------------------------------------------------------------------------------------

PARTS = list("abcdestrvml'' \n\t  .,!0129") + ["é", " ", "　", "Ω", "日", "՘", "'s", "'re", "'ll", "'ve", "<|endoftext|>", "‍", "😀", "\r\n", "x" * 5, "A", " the", "ing", "\x00", "\u001c", "ﬁ", "₏"]


def texts(seed, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


@pytest.fixture(scope="module")
def counter():
    return tokenfst.TokenCounter(A, tokenfst.char_kinds(A))


def test_counts_equal_the_library(counter, library):
    rnd = random.Random(2)
    some = texts(1, 4000, 40) + ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(rnd.randint(0, 2000))) for _ in range(40)]
    some += ["a" * 5000, "ab" * 3000, " " * 3000, "-" * 777, "é" * 999, "", "<|endoftext|>", "日本" * 400, "x" * 127, "x" * 128, "x" * 129, "'", "'r", "it'll've"]
    assert counter.counts(some).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_counts_when_the_table_starts_anew(counter, library, monkeypatch):
    monkeypatch.setattr(tokenfst, "TRANSITIONS", 50)
    monkeypatch.setattr(tokenfst, "PIECES", 300)
    some = texts(7, 300, 40)
    assert counter.counts(some).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_wrong_guesses_are_read_again(counter, library, monkeypatch):
    monkeypatch.setattr(tokenfst, "PART", 3)
    monkeypatch.setattr(tokenfst, "WARM", 1)
    some = ["international", "a" * 100, "abcdefgh" * 9, "supercalifragilistic" * 5]
    assert counter.counts(some).tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_splits_equal_the_library(counter, library):
    for t in texts(11, 3000, 12):
        t = t.replace("<|endoftext|>", "")
        if t:
            got = np.flatnonzero(counter.splitter.beginnings(np.array([ord(c) for c in t]), np.array([len(t)]))).tolist()
            assert got == [s for _, (s, _) in library.pre_tokenizer.pre_tokenize_str(t)], t


def test_prefix_scan_is_composition():
    rnd = np.random.default_rng(0)
    maps = rnd.integers(0, 5, (37, 5))
    want, so_far = [], np.arange(5)
    for m in maps:
        so_far = m[so_far]
        want.append(so_far)
    assert (tokenfst.composed(maps) == np.array(want)).all()


def test_token_counts_of_rows(spark, library):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "it's <|endoftext|> here"), (4, "word " * 1025), (5, "word " * 1023)]
    got = tokenfst.token_counts(frame(spark, rows).withColumn("n_bytes", F.lit("old")), A)
    assert got.columns == ["doc_id", "score", "n", "row", "item", "term", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), len(library.encode(t or "").ids)) for d, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.row) for r in got.collect()), key=str) == sorted(((*w, w[2] > 1024, "r") for w in want), key=str)
    assert tokenfst.token_counts(frame(spark, rows).limit(0), A).count() == 0


# --- alignment -------------------------------------------------------------------------------------------------


def spans(raws):
    ends = np.cumsum([len(r) for r in raws]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def alignments(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    letters = tokenfst.byte_letters()
    out, held = [], Counter()
    for d, text in rows:
        r = [d, 0, 0, 0, 0, "", []]
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            x = spans([bytes(letters[c] for c in t.id_to_token(i)) for i in a])
            raw = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw) == (" " + text).encode():
                y, lo, groups = spans(raw), 0, []
                for end in sorted({e for _, e in x} & {e for _, e in y}):
                    groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, at, strict=True) if lo < e <= end) for ids, at in ((a, x), (b, y))))
                    lo = end
                links = [(i, j) for i, (s, e) in zip(a, x, strict=True) for j, (s2, e2) in zip(b, y, strict=True) if s < e2 and s2 < e]
                r = [d, len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links]
        held.update(set(r[6]))
        out.append(r)
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return sorted(((*r[:5], sum(held[p] == top[p[0]] for p in r[6]), sum(held[p] for p in r[6]), r[5]) for r in out), key=str)


EXTRA = [(9001, None), (9002, ""), (9003, "a▁b"), (9004, " "), (9005, "   "), (9006, "x" * 1500), (9007, "x y " * 200), (9008, " lead"), (9009, "trail  "), (9010, "<s> </s> <unk> <0x41>"), (None, "no id"), (9008, " lead"), (9011, "▁"), (9012, "tab\tand  two")]


@pytest.mark.parametrize("run", [None, 300])
def test_alignment_equals_brute_force(spark, monkeypatch, run):
    if run:  # many runs in a task
        monkeypatch.setattr(align, "RUN", run)
    rows = list(enumerate(texts(3, 400, 40))) + EXTRA
    got = align.alignments(frame(spark, rows), A, B)
    assert sorted(map(tuple, got.collect()), key=str) == alignments(rows)


def test_alignment_of_empty_tables(spark):
    d = frame(spark, EXTRA)
    assert align.alignments(d.limit(0), A, B).count() == 0
    assert {tuple(r)[1:] for r in align.alignments(d.filter("doc_id < 9004"), A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_aligned_slices():
    groups, links = align.aligned([1, 2, 3], [2, 5, 6], [7, 8, 9], [4, 5, 6])
    assert groups == [(0, 2, 0, 2), (2, 3, 2, 3)] and links == [x << 32 | y for x, y in ((1, 7), (2, 7), (2, 8), (3, 9))]


def test_stretches_of_a_batch_as_one_by_one():
    """A batch gives what each stretch gives, also where some are not spelled by their tokens."""
    pair = align.Pair(A, B)
    kinds = list(dict.fromkeys(align.stretches([*texts(4, 200, 60), *[t or "" for _, t in EXTRA]])[2]))
    for some in (kinds, [" \u2581"], [" a", " \u2581", " b\u2581c", " d"]):
        a, b = pair.encoded(some)
        assert pair.batch(some, a, b) == [pair.stretch(*x) for x in zip(some, a, b, strict=True)]
