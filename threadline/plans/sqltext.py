"""SQL spellings of the text functions, for the queries' SQL."""

from __future__ import annotations

from ..config import BOT_ACCOUNTS, DELETED_MARKERS, LOW_VALUE_PATTERNS, MEDIA_DOMAINS, MODERATION_PATTERNS
from ..functions.text import MARKUP, NOT_SPACE, SPACE, stopwords


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {q(pattern.replace('(?dm)', '(?m)'))}, {q(to.replace('$1', chr(92) + '1'))}, 'g')"


def chain(e: str, rules) -> str:
    for pattern, to in rules:
        e = sub(e, pattern, to)
    return e


def urls(e: str) -> str:
    return chain(e, [(rf"https?://{NOT_SPACE}+", ""), (rf"www\.{NOT_SPACE}+", "")])


def links(e: str) -> str:
    return sub(e, r"\[([^\]]+)\]\([^)]+\)", "$1")


def markup(e: str) -> str:
    return chain(e, MARKUP)


def edits(e: str) -> str:
    return sub(e, rf"(?i)\b(edit|update){SPACE}*\p{{Nd}}*{SPACE}*:")


def strip(e: str) -> str:
    return chain(e, [(rf"^{SPACE}+", ""), (rf"{SPACE}+$", "")])


def blanks(e: str) -> str:
    return strip(chain(e, [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]))


def clean(e: str) -> str:
    return blanks(edits(markup(links(urls(f"coalesce({e}, '')")))))


def words(e: str) -> str:
    return f"len(regexp_extract_all(coalesce({e}, ''), {q(NOT_SPACE + '+')}))"


def normal(e: str) -> str:
    return strip(chain(f"lower(coalesce({e}, ''))", [(rf"http{NOT_SPACE}+|www{NOT_SPACE}+", ""), (r"[^\p{L}\p{N}_\s]", " "), (r"\p{Nd}+", ""), (rf"{SPACE}+", " ")]))


def terms(e: str) -> str:
    stop = "[" + ", ".join(q(w) for w in stopwords()) + "]"
    return f"list_filter(string_split({normal(e)}, ' '), lambda x: len(x) >= 3 AND NOT list_contains({stop}, x))"


def grams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def deleted(e: str) -> str:
    return f"({e} IS NULL OR " + " OR ".join(f"contains(lower({e}), {q(m)})" for m in DELETED_MARKERS) + ")"


def deleted_author(e: str) -> str:
    return f"({e} IS NULL OR lower({strip(e)}) IN ('[deleted]', 'deleted', ''))"


def bot(e: str) -> str:
    return f"(lower(coalesce({e}, '')) IN (" + ", ".join(q(b.lower()) for b in BOT_ACCOUNTS) + "))"


def short(e: str, n: int) -> str:
    return f"({e} IS NULL OR {words(e)} < {n})"


def mostly_url(e: str) -> str:
    left = f"len({strip(sub(f'coalesce({e}, {q(str())})', f'https?://{NOT_SPACE}+'))})"
    media = " OR ".join(f"contains(lower({e}), {q(d)})" for d in MEDIA_DOMAINS)
    return f"({e} IS NOT NULL AND ({strip(e)} = '' OR (len({e}) < 200 AND ({media})) OR {left} = 0 OR coalesce({left} / nullif(len({e}), 0), 0) < 0.3))"


def moderation(e: str) -> str:
    return f"regexp_matches(coalesce({e}, ''), {q('(?i)' + '|'.join(MODERATION_PATTERNS))})"


def low_value(e: str) -> str:
    pattern = "(?i)" + "|".join(LOW_VALUE_PATTERNS).replace(r"\w", r"[\p{L}\p{N}_]")
    return f"regexp_matches({strip(f'coalesce({e}, {q(str())})')}, {q(pattern)})"


def letters(e: str, ratio: float) -> str:
    return f"coalesce(len({sub(f'coalesce({e}, {q(str())})', chr(92) + 'P{L}')}) / nullif(len({e}), 0) >= {ratio}, false)"


def reasons(author: str, body: str) -> dict[str, str]:
    return {
        "deleted_author": deleted_author(author), "bot": bot(author), "deleted": deleted(body), "too_short": short(body, 5), "mostly_url": mostly_url(body),
        "moderation": moderation(body), "low_value": low_value(body), "no_letters": f"NOT {letters(body, 0.3)}",
    }
