"""Sentiment: scorers and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import signed_score
from ..functions.text import model_input, normalize_for_terms


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> tuple[Column, Column]:
    """(label, confidence) from word lists: the balance of hits over all hits."""
    words = F.split(normalize_for_terms(F.coalesce(model_input(text, 1 << 30), F.lit(""))), " ")
    hits = lambda ws: F.size(F.filter(words, lambda x: x.isin(ws)))
    p, n = hits(positive), hits(negative)
    balance = F.coalesce(F.try_divide((p - n).cast("double"), p + n), F.lit(0.0))
    return F.when(balance > 0, "positive").when(balance < 0, "negative").otherwise("neutral"), F.abs(balance)


def score_sentiment(df: DataFrame, label: Column, confidence: Column) -> DataFrame:
    return df.withColumns({"sentiment_label": label, "sentiment_confidence": confidence, "sentiment_score": signed_score(label, confidence)})


def score_with(df: DataFrame, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], text: str = "text", n: int = 512) -> DataFrame:
    """A scorer of the user's: load() once a worker, then batches of texts to (label, confidence); a failed batch is neutral."""

    @F.pandas_udf("label string, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = load()
        for b in batches:
            out = pd.DataFrame({"label": "neutral", "confidence": 0.0}, index=b.index)
            ok = b.notna()
            try:
                if ok.any():
                    out.loc[ok, ["label", "confidence"]] = score(b[ok]).to_numpy()
            except Exception:  # the scorer's own failure leaves its batch neutral
                out = pd.DataFrame({"label": "neutral", "confidence": 0.0}, index=b.index)
            yield out

    d = df.withColumn("_s", run(model_input(F.col(text), n)))
    return score_sentiment(d, F.col("_s.label"), F.col("_s.confidence")).drop("_s")


def aggregate(df: DataFrame, *by: str, score="sentiment_score", label="sentiment_label") -> DataFrame:
    """Mean, sample deviation, counts and ratios by label, for each group (or overall)."""
    n = F.count("*")
    of = {k: F.count_if(F.col(label) == v) for k, v in (("positive", "positive"), ("negative", "negative"), ("neutral", "neutral"))}
    return df.groupBy(*by).agg(
        F.avg(score).alias("mean_sentiment"), F.stddev_samp(score).alias("std_sentiment"), n.alias("total"),
        *[c.alias(f"{k}_count") for k, c in of.items()], *[F.try_divide(c.cast("double"), n).alias(f"{k}_ratio") for k, c in of.items()],
    )
