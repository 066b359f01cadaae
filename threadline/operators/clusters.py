"""Clusters of vectors: components, summaries, evolution, and the tables behind their charts; `density` finds the clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import sentiment_bucket
from ..sources.shared import discard, written
from .stats import row_shares, seeded_order, top_values, with_share
from .vectors import centroids, cosine


#: Edges up to which one task finds the components.
FEW_EDGES = 200_000


def united(edges: DataFrame) -> DataFrame:
    """Components of a counted, small edge table by union-find in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = sorted((top(x), top(y)))
                up[y] = x  # the smaller id stays on top
        yield pa.RecordBatch.from_pydict({"id": list(up), "root": [top(x) for x in list(up)]}, pa.schema([("id", types[kind]), ("root", types[kind])]))

    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"id {kind}, root {kind}")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, root) of the vertices of edges (a, b): root is the smallest id reachable. Few edges, by count, go to one task.

    Else min-label propagation with pointer jumping; each round is written, so
    that lineage stays short, and the round before deleted.
    """
    if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES and edges.schema["a"].dataType.simpleString() in ("bigint", "int", "string"):
        return united(edges)
    e = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    lab = written(e.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id").withColumn("was", F.lit(None).cast(e.schema["a"].dataType)), "labels")
    for _ in range(rounds):
        now = lab.select("id", "root")
        near = e.join(now.hint("shuffle_hash"), F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("near"))
        low = now.join(near.hint("shuffle_hash"), F.col("id") == F.col("a")).select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = now.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = written(low.join(up.hint("shuffle_hash"), "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"), "was"), "labels")
        discard(lab)
        lab = new
        if new.filter("root <> was").limit(1).count() == 0:
            discard(e)
            return new.select("id", "root")
    raise RuntimeError("components did not settle")


def cluster_summary(df: DataFrame, cluster="cluster_id", community="subreddit", ts="ts", sentiment: str | None = None) -> DataFrame:
    """Size, communities (a map and the most frequent one, the smallest of several), time range, sentiment; noise is left out."""
    d = df.filter(F.col(cluster) != -1)
    extra = [F.avg(sentiment).alias("mean_sentiment"), F.stddev_samp(sentiment).alias("std_sentiment")] if sentiment else []
    main = d.groupBy(cluster).agg(F.count("*").alias("n"), F.mode(community, True).alias("top_community"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), *extra)
    spread = d.groupBy(cluster, community).agg(F.count("*").alias("k")).groupBy(cluster).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(community, "k")))).alias("communities"))
    return main.join(spread, cluster)


def totals(df: DataFrame, cluster="cluster_id") -> DataFrame:
    noise = F.count_if(F.col(cluster) == -1)
    return df.agg(F.countDistinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("clusters"), noise.alias("noise"), (100.0 * F.try_divide(noise.cast("double"), F.count("*"))).alias("noise_pct"))


def temporal_clusters(df: DataFrame, period: Column, cluster="cluster_id") -> DataFrame:
    """(period, cluster, n, share in the period), noise left out."""
    n = df.filter(F.col(cluster) != -1).groupBy(period.alias("period"), cluster).agg(F.count("*").alias("n"))
    return with_share(n, "n", ("period",))


def evolution(df: DataFrame, period="period", cluster="cluster_id", vec="embedding", threshold: float = 0.7) -> DataFrame:
    """Best match of each cluster among the next period's clusters, by centroid cosine; positive ones from the threshold on."""
    c = written(centroids(df.filter(F.col(cluster) != -1), period, cluster, vec=vec), "centroids")
    following = c.select(period).distinct().withColumn("to_period", F.lead(period).over(Window.orderBy(period)))  # a row a period
    a = c.join(F.broadcast(following), period)
    b = c.select(F.col(period).alias("to_period"), F.col(cluster).alias("to_cluster"), F.col("centroid").alias("to_centroid"), F.col("n").alias("to_count"))
    m = a.join(b, "to_period").withColumn("similarity", cosine(F.col("centroid"), F.col("to_centroid")))
    w = Window.partitionBy(period, cluster).orderBy(F.desc("similarity"), "to_cluster")
    best = m.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") == 1) & (F.col("similarity") > 0) & (F.col("similarity") >= threshold))
    return best.select(F.col(period).alias("from_period"), "to_period", F.col(cluster).alias("from_cluster"), "to_cluster", "similarity", F.col("n").alias("from_count"), "to_count")


def flow_edges(evo: DataFrame, scale: int = 10) -> DataFrame:
    """Edges between numbered nodes (period, cluster), numbered in that order."""
    a = evo.select(F.struct(F.col("from_period").alias("p"), F.col("from_cluster").alias("c")).alias("node"))
    b = evo.select(F.struct(F.col("to_period").alias("p"), F.col("to_cluster").alias("c")).alias("node"))
    ids = a.union(b).distinct().withColumn("id", F.row_number().over(Window.orderBy("node")) - 1)  # a row a cluster and period
    e = evo.withColumns({"_a": F.struct(F.col("from_period").alias("p"), F.col("from_cluster").alias("c")), "_b": F.struct(F.col("to_period").alias("p"), F.col("to_cluster").alias("c"))})
    e = e.join(ids.select(F.col("node").alias("_a"), F.col("id").alias("source")), "_a").join(ids.select(F.col("node").alias("_b"), F.col("id").alias("target")), "_b")
    return e.select("source", "target", (F.col("from_count") * scale).alias("value"), "similarity")


def river(df: DataFrame, period: Column, k: int, cluster="cluster_id") -> DataFrame:
    """Counts per period for the k largest clusters, a column each."""
    d = df.filter(F.col(cluster) != -1)
    return d.groupBy(period.alias("period")).pivot(cluster, top_values(d, cluster, k)).agg(F.count(F.lit(1))).na.fill(0)


def heatmap(df: DataFrame, group: str, cluster="cluster_id") -> DataFrame:
    return row_shares(df.filter(F.col(cluster) != -1), group, cluster)


def sample_texts(df: DataFrame, cluster="cluster_id", prob="cluster_prob", id="id", n: int = 20, seed: int = 42) -> DataFrame:
    """Per cluster the n/2 most probable members and as many others by a seeded digest, ranked.

    Both halves are cut by rank before they are compared: of the n digest-first
    members at most n/2 can be among the most probable.
    """
    half = n // 2
    top = df.withColumn("sample_rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(prob), id))).filter(F.col("sample_rank") <= half)
    drawn = df.withColumn("_h", F.row_number().over(Window.partitionBy(cluster).orderBy(seeded_order(id, seed), id))).filter(F.col("_h") <= n)
    rest = drawn.join(top.select(F.col(cluster).alias("_c"), F.col(id).alias("_i")).hint("shuffle_hash"), (F.col(cluster) == F.col("_c")) & (F.col(id) == F.col("_i")), "left_anti")
    rest = rest.withColumn("sample_rank", F.row_number().over(Window.partitionBy(cluster).orderBy("_h")) + half).filter(F.col("sample_rank") <= n).drop("_h")
    return top.unionByName(rest)


def summary_requests(samples: DataFrame, summary: DataFrame, cluster="cluster_id", text="text", each: int = 500, budget: int = 8000) -> DataFrame:
    """One request a cluster: numbered, cut samples within a running budget of characters, and the cluster's figures: size, main community, time range, mood if there is one."""
    piece = F.when(F.length(text) > each, F.concat(F.substring(text, 1, each), F.lit("..."))).otherwise(F.col(text))
    d = samples.withColumn("_piece", F.concat(F.lit("["), F.col("sample_rank"), F.lit("] "), piece))
    w = Window.partitionBy(cluster).orderBy("sample_rank").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_sum", F.sum(F.length("_piece")).over(w)).filter(F.col("_sum") <= budget)
    per = d.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "_piece"))), lambda x: x["_piece"]), "\n\n").alias("samples"), F.count("*").alias("n_samples"))
    j = per.join(summary, cluster)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    when = F.coalesce(F.concat(F.lit(", from "), day("first_at"), F.lit(" to "), day("last_at")), F.lit(""))
    mood = F.coalesce(F.concat(F.lit(", "), sentiment_bucket(F.col("mean_sentiment")), F.lit(" on the whole")), F.lit("")) if "mean_sentiment" in summary.columns else F.lit("")
    request = F.concat(F.format_string("Cluster of %d posts, mostly from r/%s", F.col("n"), F.col("top_community")), when, mood, F.lit(".\n\nSamples:\n\n"), F.col("samples"), F.lit("\n\nAnswer with JSON: label, summary."))
    return j.withColumn("request", request).select(cluster, "n", "n_samples", "top_community", "request")
