"""Tables that are stored by the hash of a column, so that joins on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def save_bucketed(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """Write a table to `path` in buckets of its key, sorted by it, and read it from the catalog.

    Rows are shuffled once, into as many tasks as buckets, so that a bucket is one
    file. Tables that are joined need the same number of buckets and keys of one
    type; the number should leave a bucket below what a task can sort in memory.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def opened(spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """A table that another session wrote so: its folder is entered into this session's catalog."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def still_to_do(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a bucketed table that are not in another one, bucket by bucket. Rows without a key stay."""
    return work.join(done.select(key).hint("merge"), key, "left_anti")


def looked_up(ids: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """A row for each id asked for, with what a bucketed store holds; only the ids are shuffled, if they are not stored so themselves."""
    return ids.select(key).distinct().join(store.hint("merge"), key, "left")
