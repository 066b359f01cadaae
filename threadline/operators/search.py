"""Keyword search over an archive, its materialisation by windows, and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import provenance
from ..sources.shared import small


def holds_all(text: Column, query: Column) -> Column:
    """Every space-separated token of the query is in the text, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.forall(F.split(F.lower(query), " +"), lambda t: F.contains(low, t))


def search(posts: DataFrame, query: str, community: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None, fields: tuple[str, ...] = (), text="text", ts="ts", by="subreddit") -> DataFrame:
    """Posts of a community and time range that match; newest first up to the limit."""
    d = posts if community is None else posts.filter(F.lower(by) == community.lower())
    d = d if start is None else d.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    d = d if end is None else d.filter(F.col(ts) < F.lit(end).cast("timestamp"))
    d = d.filter(holds_all(F.col(text), F.lit(query)))
    d = d if limit is None else d.orderBy(F.desc(ts)).limit(limit)
    return d.select(*fields) if fields else d


def matched_queries(posts: DataFrame, queries: list[str], text="text") -> DataFrame:
    """Posts that match some query, with _matched_queries in query order; queries are a stated list, tested in the row."""
    hits = F.array_compact(F.array(*[F.when(holds_all(F.col(text), F.lit(q)), q) for q in queries]))
    return posts.withColumn("_matched_queries", hits).filter(F.size("_matched_queries") > 0)


def query_hits(matched: DataFrame) -> DataFrame:
    return matched.select(F.explode("_matched_queries").alias("query")).groupBy("query").agg(F.count("*").alias("n"))


def scan_grid(communities: list[str], windows: DataFrame, queries: list[str]) -> DataFrame:
    """(community, window_start, window_end, query): all scans of a collection, made of three stated lists."""
    dims = F.array(*[F.struct(F.lit(c).alias("community"), F.lit(q).alias("query")) for c in communities for q in queries])
    return windows.select("window_start", "window_end", F.explode(dims).alias("d")).select("d.community", "window_start", "window_end", "d.query")


def windowed_matches(posts: DataFrame, communities: list[str], windows: DataFrame, queries: list[str], granularity: str, kind: str, text="text", ts="ts", by="subreddit") -> DataFrame:
    """A row a post and window that holds it (both ends included), of the communities, with the queries it matches and where it comes from.

    The grid of scans is met in one pass: communities and queries are tested in
    the row, and posts meet windows by day.
    """
    d = matched_queries(posts.filter(F.lower(by).isin([c.lower() for c in communities])), queries, text).withColumn("_d", F.to_date(ts))
    first, last = F.col("window_start").cast("timestamp"), F.col("window_end").cast("timestamp")
    days = (first == F.date_trunc("day", first)) & (last == F.date_trunc("day", last))  # a window of days: its last one counts whole
    end = F.when(days, last + F.expr("interval 86399999999 microseconds")).otherwise(last)
    w = windows.select(F.col("window_start").cast("timestamp").alias("_window_start"), end.alias("_window_end"))
    w = w.withColumn("_d", F.explode(F.sequence(F.to_date("_window_start"), F.to_date("_window_end"))))
    j = d.join(small(w), "_d").filter((F.col(ts) >= F.col("_window_start")) & (F.col(ts) <= F.col("_window_end"))).drop("_d")
    return provenance(j, granularity=granularity, collection_type=kind)


def collect_windows(posts: DataFrame, communities: list[str], windows: DataFrame, queries: list[str], granularity: str = "monthly", kind: str = "historical", text="text", ts="ts", by="subreddit", id="id") -> DataFrame:
    """Posts of the grid once each: the first window's tags, the union of the queries."""
    return collected(windowed_matches(posts, communities, windows, queries, granularity, kind, text, ts, by), id, "_window_start")


def collected(matched: DataFrame, id="id", window="window_start") -> DataFrame:
    """One row a post over overlapping windows: the first window's fields, the union of the queries."""
    w = Window.partitionBy(id).orderBy(window)
    first = matched.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_matched_queries")
    q = matched.groupBy(id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_matched_queries")))).alias("_matched_queries"))
    return first.join(q.hint("shuffle_hash"), id)


def without_done(work: DataFrame, done: DataFrame, id="id") -> DataFrame:
    return work.join(done.select(id), id, "left_anti")


def comment_worklist(posts: DataFrame, done: DataFrame, min_comments: int = 1, most: int | None = None, id="id", comments="num_comments") -> DataFrame:
    """Posts still to fetch comments for, most comments first."""
    d = without_done(posts.filter(F.col(comments) >= min_comments), done, id).orderBy(F.desc(comments), id)
    return d if most is None else d.limit(most)


def shard_completeness(posts: DataFrame, done: DataFrame, shard: str, min_comments: int, id="id", comments="num_comments") -> DataFrame:
    """(shard, eligible, processed, complete)."""
    e = posts.filter(F.col(comments) >= min_comments).groupBy(shard).agg(F.count("*").alias("eligible"))
    p = done.groupBy(shard).agg(F.countDistinct(id).alias("processed"))
    j = e.join(p, shard, "left").withColumn("processed", F.coalesce("processed", F.lit(0).cast("long")))
    return j.withColumn("complete", F.col("processed") >= F.col("eligible"))
