"""Embeddings as arrays keyed by id: making, reducing, averaging, comparing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def embed(df: DataFrame, text: str = "text", dim: int = 256, out: str = "embedding") -> DataFrame:
    """Hashed TF-IDF of unit length, of texts or of arrays of terms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from .terms import words_of

    d = df.withColumn("_t", words_of(df, text))
    p = Pipeline(stages=[HashingTF(inputCol="_t", outputCol="_tf", numFeatures=dim), IDF(inputCol="_tf", outputCol="_w"), Normalizer(inputCol="_w", outputCol="_n")])
    return p.fit(d).transform(d).withColumn(out, vector_to_array("_n")).drop("_t", "_tf", "_w", "_n")


def embed_with(df: DataFrame, load: Callable[[], Callable[[pd.Series], list]], text: str = "text", out: str = "embedding") -> DataFrame:
    """An embedder of the user's: load() once a worker, then batches of texts to vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load()
        for b in batches:
            yield pd.Series(list(f(b.fillna(""))), index=b.index)

    return df.withColumn(out, run(F.col(text)))


def reduce_dimensions(df: DataFrame, k: int, vec: str = "embedding", out: str = "reduced") -> DataFrame:
    """Principal components: the linear stand-in for a non-linear reduction."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(d).transform(d).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def centroids(df: DataFrame, *by: str, vec: str = "embedding") -> DataFrame:
    """Mean vector and size of each group; the sums are partial, so a large group is no burden."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    d = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return d.groupBy(*by).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count("*").alias("n")).withColumn("centroid", vector_to_array("_m")).drop("_m")
