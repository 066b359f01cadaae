"""Text rewrites as Column functions: nothing here leaves the JVM except full accent folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ENGLISH_STOPWORDS, EXTRA_STOPWORDS

#: White space and words in the Unicode sense; the spelling works for Java and RE2 alike.
SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
NOT_SPACE = r"[^\s\p{Z}\x0B\x1C-\x1F\x{85}]"
#: The code-point ranges that count as emoji; the last one also takes CJK.
EMOJI = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}"
EMOJI_WIDE = r"\x{24C2}-\x{1F251}"
#: Markup rewrites in the order that they apply in, as (pattern, replacement).
MARKUP = [
    (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"_([^_]+)_", "$1"), (r"~~([^~]+)~~", "$1"),
    (r"\^+\(([^)]+)\)", "$1"), (rf"\^+({NOT_SPACE}+)", "$1"), (r">!([^!]+)!<", "$1"), (r"```[^`]*```", ""), (r"`([^`]+)`", "$1"),
    (rf"(?dm)^>{SPACE}*", ""), (r"(?dm)^[-*_]{3,}$", ""), (rf"(?dm)^#{{1,6}}{SPACE}+", ""),
]


def rewritten(t: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        t = F.regexp_replace(t, pattern, to)
    return t


def remove_urls(t: Column) -> Column:
    return rewritten(t, [(rf"https?://{NOT_SPACE}+", ""), (rf"www\.{NOT_SPACE}+", "")])


def remove_markdown_links(t: Column) -> Column:
    return F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")


def remove_markup(t: Column) -> Column:
    return rewritten(t, MARKUP)


def remove_edit_markers(t: Column, cut: bool = False) -> Column:
    """Drop `Edit 2:` and `Update:` (fixed patterns); with cut all that follows one, too (only these spellings)."""
    if cut:
        return F.regexp_replace(t, rf"(?s)\b(Edit|EDIT|edit|Update|UPDATE){SPACE}*\p{{Nd}}*{SPACE}*:.*$", "")
    return F.regexp_replace(t, rf"(?i)\b(edit|update){SPACE}*\p{{Nd}}*{SPACE}*:", "")


def remove_emojis(t: Column, strict: bool = False) -> Column:
    """Without strict, the wide range goes as well, and CJK text with it."""
    return F.regexp_replace(t, f"[{EMOJI}{'' if strict else EMOJI_WIDE}]+", "")


def strip(t: Column) -> Column:
    return rewritten(t, [(rf"^{SPACE}+", ""), (rf"{SPACE}+$", "")])


def normalize_whitespace(t: Column) -> Column:
    return strip(rewritten(t, [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]))


def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


#: Latin letters with one accent and their base letters, derived from Unicode decomposition.
_LATIN = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]


def normalize_accents(t: Column, full: bool = False) -> Column:
    """Fold accents; Latin letters in the JVM, all of Unicode (full) in an Arrow batch function."""
    if full:
        return F.pandas_udf(_fold, "string")(t)
    return F.regexp_replace(F.translate(t, "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN)), r"[\x{300}-\x{36F}]", "")


def clean_text(t: Column, *, urls=True, links=True, markup=True, edits=True, emojis=False, accents=False, lower=False) -> Column:
    """The rewrites in their order; null gives an empty string."""
    t = F.coalesce(t, F.lit(""))
    for on, f in ((urls, remove_urls), (links, remove_markdown_links), (markup, remove_markup), (edits, remove_edit_markers), (emojis, remove_emojis), (accents, normalize_accents)):
        t = f(t) if on else t
    t = normalize_whitespace(t)
    return F.lower(t) if lower else t


def word_count(t: Column) -> Column:
    """Words of a text (null: none); split, as counting matches of a pattern costs ten times as much."""
    return F.size(F.array_remove(F.split(F.coalesce(t, F.lit("")), f"{SPACE}+"), ""))


def normalize_for_terms(t: Column) -> Column:
    """Lower-case letters and single spaces: no URLs, punctuation or digits; null gives an empty string."""
    t = F.lower(F.coalesce(t, F.lit("")))
    t = rewritten(t, [(rf"http{NOT_SPACE}+|www{NOT_SPACE}+", ""), (r"[^\p{L}\p{N}_\s]", " "), (r"\p{Nd}+", ""), (rf"{SPACE}+", " ")])
    return strip(t)


def stopwords(base: list[str] | None = None) -> list[str]:
    """English stop words (or another language's) and the extra ones."""
    return sorted({*(ENGLISH_STOPWORDS if base is None else base), *EXTRA_STOPWORDS})


def tokens(t: Column) -> Column:
    """The words of normalize_for_terms, with empty strings among them, in three passes over the text instead of seven."""
    t = F.lower(F.coalesce(t, F.lit("")))
    return F.split(rewritten(t, [(rf"http{NOT_SPACE}+|www{NOT_SPACE}+", ""), (r"\p{Nd}+", "")]), r"[^\p{L}\p{N}_]+")


def is_term(x: Column, stop: list[str] | None = None, min_length: int = 3) -> Column:
    return (F.length(x) >= min_length) & ~x.isin(stopwords() if stop is None else stop)


def terms(t: Column, stop: list[str] | None = None, min_length: int = 3) -> Column:
    """Normalised tokens without stop words (by default the English and the extra ones) and short ones, in text order."""
    stop = stopwords() if stop is None else stop
    return F.filter(tokens(t), lambda x: is_term(x, stop, min_length))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of an array; fewer tokens than n give none."""
    if n == 1:
        return tokens

    def of(t: Column) -> Column:
        size = F.greatest(F.size(t) - (n - 1), F.lit(0))
        out = F.slice(t, 1, size)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(t, k + 1, size), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    # bound once as a lambda variable: written in place, the tokens would be made anew for every part
    return F.transform(F.array(tokens), of)[0]


def preview(t: Column, n: int = 200) -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def response_record(t: Column, schema: str, fallback: str = "Unknown", n: int = 500) -> Column:
    """The JSON object in a model's answer, or else a record of the fallback and the first characters."""
    found = F.from_json(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")), schema)
    fields = [f.split(None, 1) for f in schema.split(",")]
    first, *rest = [name for name, _ in fields]
    named = [F.lit(fallback).alias(first)] + [F.substring(t, 1, n).alias(rest[0])] + [F.lit(None).alias(x) for x in rest[1:]]
    return F.when(found.getField(first).isNotNull(), found).otherwise(F.struct(*named).cast("struct<" + ",".join(f"{n}:{t.strip()}" for n, t in fields) + ">"))


def model_input(t: Column, n: int = 512) -> Column:
    """What a scorer sees: the first n characters; null for blank text, which scores neutral."""
    return F.when(strip(F.coalesce(t, F.lit(""))) != "", F.substring(t, 1, n))
