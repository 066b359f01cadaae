"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a temporary folder of a local session's own; a cluster needs the setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-threadline-")
        spark.sparkContext.setCheckpointDir(base)
    base = "file://" + base if base.startswith("/") else base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write a table to the shared folder (partitioned by a column, if one is given) and read it back: lineage ends there, and its size is known."""
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])  # a partitioning column comes back last
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables; only when all that was made of them is written too."""
    for t in tables:
        path = t.__dict__.get("_written_to")
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join that should be small: broadcast if it is counted to be, else a shuffled hash join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_hash")
