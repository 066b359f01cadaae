"""Cleaning posts and comments, with counts of what was dropped and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X


def clean_submissions(df: DataFrame, author="author", title="title", selftext="selftext", min_words: int = 2, **flags) -> DataFrame:
    """Valid submissions with title_clean, selftext_clean and full_text, in one narrow stage."""
    ok = df.filter(P.valid_submission(F.col(author), F.col(title), F.col(selftext), min_words))
    ok = ok.withColumns({"title_clean": X.clean_text(F.col(title), **flags | {"edits": False}), "selftext_clean": X.clean_text(F.col(selftext), **flags)})
    return ok.withColumn("full_text", F.trim(F.concat_ws(" ", "title_clean", "selftext_clean")))


def clean_comments(df: DataFrame, author="author", body="body", min_words: int = 5, **flags) -> DataFrame:
    """Valid comments with body_clean, which has enough words itself."""
    ok = df.filter(P.valid_comment(F.col(author), F.col(body), min_words)).withColumn("body_clean", X.clean_text(F.col(body), **flags))
    return ok.filter(X.word_count(F.col("body_clean")) >= min_words)


def reason_counts(df: DataFrame, author="author", body="body") -> DataFrame:
    """(reason, n): rows that each test alone would drop; one scan."""
    r = P.comment_reasons(F.col(author), F.col(body))
    one = df.agg(*[F.count_if(c).alias(k) for k, c in r.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("n")) for k in r])))


def first_reason_counts(df: DataFrame, author="author", body="body") -> DataFrame:
    """(reason, n): each row under the first test that drops it, `kept` without one; they add up to all rows."""
    out = F.lit("kept")
    for k, c in reversed(P.comment_reasons(F.col(author), F.col(body)).items()):
        out = F.when(c, k).otherwise(out)
    return df.groupBy(out.alias("reason")).agg(F.count("*").alias("n"))


def retention(df: DataFrame, kept) -> DataFrame:
    n, k = F.count("*"), F.count_if(kept)
    return df.agg(n.alias("total"), k.alias("kept"), (100.0 * F.try_divide(k.cast("double"), n)).alias("kept_pct"))
