"""Streams of posts: new shards, de-duplication, window counts, cleaning, query hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean_comments
from ..operators.search import matched_queries
from ..sources.archive import ITEM_END, items_of


def stream_posts(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Items of new keyed-JSON shards; the query's checkpoint remembers which files are done."""
    raw = spark.readStream.format("text").option("lineSep", ITEM_END).option("pathGlobFilter", glob).load(path)
    return items_of(raw, schema, salvage=False)


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder (or file) as a stream; the schema is read from it once."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path if not path.endswith(".parquet") else path)


def dedup_stream(df: DataFrame, id: str, ts: str, delay: str = "7 days") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id])


def stream_window_counts(df: DataFrame, ts: str, community: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Posts per window and community; rows later than the delay are dropped."""
    c = df.withWatermark(ts, delay).groupBy(F.window(ts, width), community).agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("window_start"), community, "n")


def stream_clean(df: DataFrame, author: str, body: str) -> DataFrame:
    """The batch rules, row by row."""
    return clean_comments(df, author, body)


def stream_query_hits(df: DataFrame, queries: list[str], ts: str, text: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    hit = matched_queries(df, queries, text).select(ts, F.explode("_matched_queries").alias("query"))
    return hit.withWatermark(ts, delay).groupBy(F.window(ts, width), "query").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "query", "n")


def stream_alignment(posts: DataFrame, events: DataFrame, ts: str = "ts", key: str = "subreddit", days: int = 7, delay: str = "1 day", unmatched: bool = False) -> DataFrame:
    """Posts with the events (event_id, event_ts, keyword) whose keyword is their key, within `days` after them; optionally also events without any.

    Both watermarks bound the state: a post waits for late events, an event for
    the posts of its days. An event without posts leaves once no post can come
    for it any more.
    """
    p = posts.withWatermark(ts, delay)
    e = events.withWatermark("event_ts", delay)
    late = F.expr(f"event_ts + interval {days} days")  # as a literal, so that the planner can bound the state
    on = (F.col("keyword") == F.col(key)) & (F.col(ts) >= F.col("event_ts")) & (F.col(ts) <= late)
    return e.join(p, on, "leftOuter" if unmatched else "inner")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what has arrived to Parquet and stop."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
