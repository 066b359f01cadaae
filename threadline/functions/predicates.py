"""Row predicates: Columns that are true or false, never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BOT_ACCOUNTS, DELETED_AUTHORS, DELETED_MARKERS, LOW_VALUE_PATTERNS, MEDIA_DOMAINS, MODERATION_PATTERNS
from .text import NOT_SPACE, strip, word_count


def blank(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def is_deleted_content(t: Column, markers=DELETED_MARKERS) -> Column:
    low = F.lower(blank(t))
    return t.isNull() | reduce(Column.__or__, [F.contains(low, F.lit(m)) for m in markers])


def is_deleted_author(a: Column) -> Column:
    return a.isNull() | F.lower(strip(blank(a))).isin(DELETED_AUTHORS)


def is_bot(a: Column, bots=BOT_ACCOUNTS) -> Column:
    return F.lower(blank(a)).isin([b.lower() for b in bots])


def is_too_short(t: Column, n: int = 5) -> Column:
    return t.isNull() | (word_count(t) < n)


def is_too_long(t: Column, n: int = 10000) -> Column:
    return F.length(blank(t)) > n


def is_mostly_url(t: Column, ratio: float = 0.7, domains=MEDIA_DOMAINS) -> Column:
    """Blank texts and short ones with a media domain; else texts of which little is left without URLs."""
    s, low = strip(blank(t)), F.lower(blank(t))
    left = F.length(strip(F.regexp_replace(blank(t), rf"https?://{NOT_SPACE}+", "")))
    media = (F.length(blank(t)) < 200) & reduce(Column.__or__, [F.contains(low, F.lit(d)) for d in domains])
    return t.isNotNull() & ((s == "") | media | (left == 0) | (F.coalesce(F.try_divide(left, F.length(blank(t))), F.lit(0.0)) < F.lit(round(1 - ratio, 10))))


def is_moderation(t: Column, patterns=MODERATION_PATTERNS) -> Column:
    return blank(t).rlike("(?id)" + "|".join(patterns).replace(r"\d", r"\p{Nd}"))


def is_low_value(t: Column, patterns=LOW_VALUE_PATTERNS) -> Column:
    return strip(blank(t)).rlike("(?id)" + "|".join(patterns).replace(r"\w", r"[\p{L}\p{N}_]"))


def has_meaningful_content(t: Column, ratio: float = 0.5) -> Column:
    """Letters over all characters; blank texts have none."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(blank(t), r"\P{L}", "")), F.length(blank(t))) >= ratio, F.lit(False))


def valid_submission(author: Column, title: Column, selftext: Column, min_words: int = 2) -> Column:
    both = F.concat_ws(" ", blank(title), blank(selftext))
    return (
        ~is_deleted_author(author) & ~is_bot(author) & ~is_deleted_content(title) & ~((blank(selftext) != "") & is_deleted_content(selftext))
        & ~is_too_short(title, min_words) & ~is_mostly_url(both) & ~is_moderation(both)
    )


def valid_comment(author: Column, body: Column, min_words: int = 5) -> Column:
    return (
        ~is_deleted_author(author) & ~is_bot(author) & ~is_deleted_content(body) & ~is_too_short(body, min_words)
        & ~is_mostly_url(body) & ~is_moderation(body) & ~is_low_value(body) & has_meaningful_content(body, 0.3)
    )


def comment_reasons(author: Column, body: Column, min_words: int = 5) -> dict[str, Column]:
    """The tests of valid_comment by name, in their order."""
    return {
        "deleted_author": is_deleted_author(author), "bot": is_bot(author), "deleted": is_deleted_content(body), "too_short": is_too_short(body, min_words),
        "mostly_url": is_mostly_url(body), "moderation": is_moderation(body), "low_value": is_low_value(body), "no_letters": ~has_meaningful_content(body, 0.3),
    }


def in_period(ts: Column, start: str, end: str) -> Column:
    """Closed interval; a date alone is its midnight."""
    return F.coalesce(ts.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), F.lit(False))


def mentions(t: Column, words: list[str]) -> Column:
    """Any of the terms as a pattern anywhere in the lower-case text."""
    return F.lower(blank(t)).rlike("|".join(words))


def not_author(a: Column, name: str = "[deleted]") -> Column:
    return ~a.eqNullSafe(F.lit(name))


def both_in(a: Column, b: Column, names: list[str]) -> Column:
    return a.isin(names) & b.isin(names)
