"""Small helpers shared by the training-data operators.

Only three things live here: where intermediate tables go, how a table is
written out and read back (to cut lineage and to fix its size), and connected
components by min-label propagation.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of a local session's own; a cluster needs the setting."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        found = sc._jsc.sc().getCheckpointDir()
        conf = found.get() if found.isDefined() else None
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        sc.setCheckpointDir(conf)
    return "file://" + conf if conf.startswith("/") else conf


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write a table to the shared folder (partitioned by a column, if one is given) and read it back: lineage ends, its size is known."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path).select(*df.columns)  # a partitioning column comes back last
    out._written_to = path
    return out


def discard_part(table_: DataFrame, column: str, value) -> None:
    """Delete the files of one value of the column that a written table is partitioned by."""
    spark, path = table_.sparkSession, table_.__dict__.get("_written_to")
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables; only when all that was made of them is written too."""
    for t in tables:
        spark, path = t.sparkSession, t.__dict__.get("_written_to")
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is the smallest node reachable.

    Min-label propagation with pointer jumping: each round a node takes the
    smallest label among its own and its neighbours', then the label of that
    label. Labels only fall, so the rounds end when none changes. Every round
    is two shuffles of the edge table; each result is written to the shared
    folder, so a lost executor costs one round at most. Nulls are not nodes.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b")
    e = written(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node").withColumn("old", F.col("node")), "labels")
    for _ in range(max_rounds):
        now = labels.select("node", "root")
        near = (
            e.join(now.hint("shuffle_hash"), F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("root").alias("near"))
        )
        step = now.join(near.hint("shuffle_hash"), F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = written(
            step.join(jump.hint("shuffle_hash"), "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"),
            "labels",
        )
        discard(labels)  # the new ones are written, and nothing else is made of these
        labels = new
        if not new.filter("old <> root").limit(1).count():
            discard(e)
            return new.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
