"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, whatever
their labels, are unlabelled. A logistic classifier in numpy minimises

    prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])

where the second term estimates the negatives' risk from unlabelled text with
the positives' share taken out; when it falls below zero, the step goes the
other way (Kiryo et al. 2017). The prior is the share of positives among the
labelled training rows.

Features are the presence of words and of their character 4- to 6-grams (word
edges marked). Candidates are counted in Spark over the training sample; those
that are at least LIFT times as frequent in positives as in unlabelled text
are kept. Fitting is on a bounded sample, taken by hash order: POSITIVES and
UNLABELLED rows at most (documented parameters); scoring covers every row.
A kept feature is in MIN_SHARE of the sampled positives at least, so there are
at most 1 / MIN_SHARE times as many as an average positive has; the table of
weights is of the sample's size whatever the corpus, and can be broadcast.

Defined results: null and empty texts get the score of a text without
features; without positives every score is zero; rows with a null id are
scored but never learned from; repeated rows stay and count once in training;
further columns are kept by `score`, where clashing names are overwritten.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import give_back
from .common import table

POSITIVES, UNLABELLED = 4000, 12000
#: A feature is a candidate if so many positives, and this share of them, have it, and it is this much likelier there.
MIN_COUNT, MIN_SHARE, LIFT = 5, 0.01, 5.0
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Words that a task remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 300_000, 64


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def word_features(w: str) -> list[str]:
    p = f"^{w}$"
    return ["=" + w] + [p[i : i + n] for n in (4, 5, 6) for i in range(len(p) - n + 1)]


def text_features(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(WORD.findall((text or "").lower())):
        out.update(word_features(w))
    return out


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 500, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; (rows, cols) are the set features, `positive` says which rows are positives."""
    n = len(positive)
    wp = np.where(positive, 1.0 / max(1, positive.sum()), 0.0)
    wu = np.where(positive, 0.0, 1.0 / max(1, (~positive).sum()))
    theta, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        z = np.bincount(rows, theta[cols], n) + theta[-1]
        up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # derivative of l(-); that of l(+) is up - 1
        soft = np.logaddexp(0, z)
        negative_risk = (wu * soft).sum() - prior * (wp * soft).sum()
        gz = prior * wp * (up - 1) + (wu - prior * wp) * up if negative_risk >= 0 else -(wu - prior * wp) * up
        g = np.append(np.bincount(cols, gz[rows], n_features), gz.sum())
        g[:-1] += l2 * theta[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """(positive, text): at most POSITIVES and UNLABELLED rows, by hash order, from rows that `learn` admits."""
    draw = lambda df, n: df.orderBy(F.xxhash64(F.lit(9), id_col), id_col).limit(n)
    pos = draw(labels.filter(learn & (F.col("toxic") == 1)).select(id_col).distinct(), POSITIVES)
    unl = draw(docs.filter(learn).select(id_col), UNLABELLED).distinct()
    ids = pos.select(id_col, F.lit(True).alias("positive")).unionAll(unl.select(id_col, F.lit(False).alias("positive")))
    # both sides of the union are limited above, so the broadcast is bounded by POSITIVES + UNLABELLED rows
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select("positive", F.col(text_col).alias("text")).distinct()


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: {"weights": {feature: weight}, "bias": ...}."""
    known = labels.filter(learn & F.col("toxic").isNotNull())
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return {"weights": {}, "bias": None}
    prior = min(max(share, 0.001), 0.9)
    sample = training_sample(docs, labels, learn, id_col, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, t in zip(b.column("positive").to_pylist(), b.column("text").to_pylist(), strict=True):
                f = pa.array(sorted(text_features(t)), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(f), pa.bool_()), f], names=["positive", "f"])
        give_back()

    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return {"weights": {}, "bias": float(np.log(prior / (1 - prior)))}
    counted = (
        sample.mapInArrow(features, "positive boolean, f string")
        .groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
        .filter((F.col("p") >= max(MIN_COUNT, MIN_SHARE * n_p)) & (F.col("p") / n_p >= LIFT * F.col("u") / n_u))
    )
    index = {f: i for i, f in enumerate(sorted(r.f for r in counted.select("f").collect()))}  # bounded by the sample, see above
    if not index:
        return {"weights": {}, "bias": float(np.log(prior / (1 - prior)))}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            got = [sorted(ix[f] for f in text_features(t) if f in ix) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array(got, pa.list_(pa.int32()))], names=["positive", "f"])

    local = sample.mapInArrow(chosen, "positive boolean, f array<int>").collect()  # the bounded sample, feature numbers only
    local.sort(key=lambda r: (r.positive, r.f))
    lens = np.array([len(r.f) for r in local])
    rows = np.repeat(np.arange(len(local)), lens)
    cols = np.array([i for r in local for i in r.f], np.int64)
    w, bias = fit_nnpu(rows, cols, np.array([r.positive for r in local]), len(index), prior)
    return {"weights": {f: float(w[i]) for f, i in index.items()}, "bias": bias}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The input's columns with `score` and `predicted`."""
    if model["bias"] is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value["weights"], shared.value["bias"]
        cache: dict[str, tuple] = {}  # the features of words that the task has met
        none: tuple = ()
        for texts in batches:
            out = []
            for t in texts:
                t = t.as_py()
                found: set[str] = set()
                for w in set(WORD.findall(t.lower())) if t else none:
                    f = cache.get(w)
                    if f is None:
                        f = tuple(x for x in word_features(w) if x in weights) or none
                        if len(w) <= CACHE_CHARS:
                            cache[w] = f
                    if f:
                        found.update(f)
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                z = bias + sum(weights[f] for f in sorted(found))
                out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.array(out, pa.float64())
        cache.clear()
        give_back()

    return docs.withColumn("score", scored(F.col(text_col))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learned(spark: SparkSession, sf_dir: str) -> dict:
    """The model from the rows outside the held-out third."""
    return train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score(docs, learned(spark, sf_dir)).select("doc_id", held, "score", "predicted")
