"""Text rewrites and predicates on literal rows, against plain Python where that is the model."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadline.functions import predicates as P
from threadline.functions import text as T


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_rewrites(spark):
    got = col(spark, ["a https://x.y/z b www.q.r c", "[t](u) **b** _i_ ~~s~~ ^(x) >!sp!<", "```code``` `in`\n> q\n---\n## H", "Edit 2: ok UPDATE: no", "a \t b\n\n\n\nc ", None], T.clean_text)
    assert got == ["a b c", "t b i s x sp", "in\nq\n\nH", "ok no", "a b\n\nc", ""]


def test_word_counts(spark):
    """Words between white space of any kind, counted without matching a pattern word by word."""
    values = ["", " ", "a", " a\u3000b\n", "\u00a0x\x1cy\x85z", "one two  three", None]
    assert col(spark, values, T.word_count) == [len((v or "").split()) for v in values]
    d = spark.createDataFrame([("a b",)], "t string").select(T.word_count(F.col("t")))
    assert "regexp_extract_all" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_edit_content_cut(spark):
    assert col(spark, ["keep Edit: drop\nall", "reedit: x"], lambda c: T.remove_edit_markers(c, cut=True)) == ["keep ", "reedit: x"]


def test_emojis_and_accents(spark):
    assert col(spark, ["a😀b中", "ñé"], lambda c: T.remove_emojis(c)) == ["ab", "ñé"]
    assert col(spark, ["a😀b中"], lambda c: T.remove_emojis(c, strict=True)) == ["ab中"]
    assert col(spark, ["canción Ñ", None], T.normalize_accents) == ["cancion N", None]


def test_full_accent_folding(spark):
    assert col(spark, ["ắ й"], lambda c: T.normalize_accents(c, full=True)) == ["".join(c for c in unicodedata.normalize("NFD", "ắ й") if unicodedata.category(c) != "Mn")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZé*_~`^>[]()!# \n\t:/.hwtps", max_size=40), min_size=1, max_size=20))
def test_markup_like_plain_python(spark, values):
    def plain(t):
        t = re.sub(r"www\.\S+", "", re.sub(r"https?://\S+", "", t))
        t = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", t)
        for p, to, fl in [
            (r"\*\*([^*]+)\*\*", r"\1", 0), (r"__([^_]+)__", r"\1", 0), (r"\*([^*]+)\*", r"\1", 0), (r"_([^_]+)_", r"\1", 0), (r"~~([^~]+)~~", r"\1", 0), (r"\^+\(([^)]+)\)", r"\1", 0),
            (r"\^+(\S+)", r"\1", 0), (r">!([^!]+)!<", r"\1", 0), (r"```[^`]*```", "", 0), (r"`([^`]+)`", r"\1", 0), (r"^>\s*", "", re.M), (r"^[-*_]{3,}$", "", re.M), (r"^#{1,6}\s+", "", re.M),
        ]:
            t = re.sub(p, to, t, flags=fl)
        return t

    assert col(spark, values, lambda c: T.remove_markup(T.remove_markdown_links(T.remove_urls(c)))) == [plain(v) for v in values]


@pytest.mark.parametrize(
    ("f", "true", "false"),
    [
        (P.is_deleted_content, [None, "x [Removed] y", "[deleted by user]"], ["", "deleted"]),
        (P.is_deleted_author, [None, "", " [deleted] ", "Deleted"], ["bob"]),
        (P.is_bot, ["AUTOMODERATOR", "WikiTextBot"], [None, "bob"]),
        (P.is_too_short, [None, "a b c d", ""], ["a b c d e"]),
        (P.is_mostly_url, ["", " ", "see imgur.com/x", "https://a.b/c", "https://a.b/cdefghij kl"], [None, "plain words here", "x" * 200 + " imgur.com"]),
        (P.is_moderation, ["Your post has been REMOVED by us", "rule 4", "violates"], [None, "fine text"]),
        (P.is_low_value, ["lol", " Thanks. ", "r/abc", "^this"], [None, "lol indeed"]),
        (lambda c: P.has_meaningful_content(c, 0.5), ["ab1", "éé"], [None, "", "1234a"]),
    ],
)
def test_predicates(spark, f, true, false):
    assert col(spark, true, f) == [True] * len(true)
    assert col(spark, false, f) == [False] * len(false)


def test_terms(spark):
    assert col(spark, ["The cat's 12 cats, http://x.y said UP", None, ""], lambda c: T.terms(c)) == [["cat", "cats"], [], []]
    assert col(spark, ["The cat's 12 cats, http://x.y said UP"], lambda c: T.terms(c, [], 2)) == [["the", "cat", "cats", "said", "up"]]
    assert col(spark, ["aaa bbb ccc", "aaa"], lambda c: T.ngrams(T.terms(c), 2)) == [["aaa bbb", "bbb ccc"], []]
