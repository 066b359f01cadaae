"""The given tables in the roles of the library: posts, comments, activity, texts, threads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions; their line items are the comments."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.lower("o_orderpriority").alias("subreddit"), F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.coalesce("n", F.lit(0)).alias("num_comments"),
    )


POSTS = """posts AS (
  SELECT o_orderkey AS id, o_custkey AS author, lower(o_orderpriority) AS subreddit, o_totalprice AS score, o_orderdate AS ts, coalesce(n, 0) AS num_comments
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed posts."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("author"), F.col("event_type").alias("subreddit"), F.col("value").alias("score"),
        F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("num_comments"),
    )


ACTIVITY = """activity AS (
  SELECT event_id AS id, user_id AS author, event_type AS subreddit, value AS score, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS num_comments FROM events)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("subreddit"), "lang")


def noisy_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns dressed up with what comments hold: markers, links, markup, bots.

    Written out once, as a comment table would be, so that the predicates read a
    column instead of the expression that made it.
    """
    t, k = F.col("text"), F.col("turn") % 8
    body = (
        F.when(k == 1, F.concat(t, F.lit(" https://a.example/x?y=1 www.b.example [link](http://c.example/d) EDIT 2: done"))).when(k == 2, F.lit("[removed]"))
        .when(k == 3, F.concat(F.lit("**"), t, F.lit("** ~~old~~ ^(small) `code`\n> quoted\n---\n## Head  two"))).when(k == 4, F.lit("see https://imgur.com/abc for this"))
        .when(k == 5, F.concat(t, F.lit(" this comment has been removed, rule 4"))).when(k == 6, F.lit("lol")).when(k == 7, F.concat(F.lit("https://a.example/long/link/to/some/page/that/goes/on "), F.substring(t, 1, 9)))
        .otherwise(t)
    )
    author = F.when(F.col("conv_id") % 11 == 0, "automoderator").when(F.col("conv_id") % 13 == 0, "[deleted]").otherwise(F.col("role"))
    return written(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", author.alias("author"), body.alias("body")), "noisy")


NOISY = r"""noisy AS (
  SELECT conv_id * 1000 + turn AS id, conv_id, turn,
    CASE WHEN conv_id % 11 = 0 THEN 'automoderator' WHEN conv_id % 13 = 0 THEN '[deleted]' ELSE role END AS author,
    CASE turn % 8 WHEN 1 THEN text || ' https://a.example/x?y=1 www.b.example [link](http://c.example/d) EDIT 2: done' WHEN 2 THEN '[removed]'
      WHEN 3 THEN '**' || text || '** ~~old~~ ^(small) `code`' || chr(10) || '> quoted' || chr(10) || '---' || chr(10) || '## Head  two' WHEN 4 THEN 'see https://imgur.com/abc for this'
      WHEN 5 THEN text || ' this comment has been removed, rule 4' WHEN 6 THEN 'lol' WHEN 7 THEN 'https://a.example/long/link/to/some/page/that/goes/on ' || substr(text, 1, 9) ELSE text END AS body
  FROM conversations)"""


def dated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their label as cluster, and the order of the same number for time and community."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lower("o_orderpriority").alias("subreddit"), F.col("o_totalprice").alias("score"))
    return e.join(o, "id").withColumn("period", F.year("ts"))


VECTORS = """vectors AS (
  SELECT vec_id AS id, embedding, label AS cluster_id, o_orderdate AS ts, lower(o_orderpriority) AS subreddit, o_totalprice AS score, year(o_orderdate) AS period
  FROM embeddings JOIN orders ON vec_id = o_orderkey)"""


LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The same, roughly the most frequent first.
BY_USE = "eainrtoslducmpghvbfykwzjxq"


def letter_counts(t: Column | str) -> Column:
    """How often each of BY_USE occurs, in that order: letters are taken out one after the other, so that the text gets shorter."""
    start = F.struct(F.replace(t, F.lit(" "), F.lit("")).alias("t"), F.array().cast("array<int>").alias("n"))
    size = lambda s: F.array_append(s["n"], F.octet_length(s["t"]))
    left = F.aggregate(F.array(*[F.lit(c) for c in BY_USE]), start, lambda s, c: F.struct(F.replace(s["t"], c, F.lit("")).alias("t"), size(s).alias("n")), size)
    return F.zip_with(F.slice(left, 1, len(BY_USE)), F.slice(left, 2, len(BY_USE)), lambda a, b: a - b)


def letter_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as vectors of how many of a thousand characters each letter is, with the year of the order of the same number; written, as embeddings would be.

    Letters are bytes of their own in UTF-8, so a text's bytes are counted, one text after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.zeros((b.num_rows, 256), np.int32)
            for i, t in enumerate(b["t"]):
                k[i] = np.bincount(np.frombuffer(t.as_buffer(), np.uint8), minlength=256)
            k = k[:, 97:123] + k[:, 65:91]
            v = np.floor(1000 * k.astype(np.int64) / b["n"].to_numpy()[:, None])
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(LETTERS))
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(at, pa.array(v.ravel()))], ["id", "embedding"])

    x = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), x.cast("binary").alias("t"), F.greatest(F.length(x), F.lit(1)).alias("n"))
    v = d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, embedding array<double>")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("period"))
    return written(v.join(o, "id", "left"), "profiles")


PROFILES = f"""profiles AS (
  SELECT doc_id AS id, [{", ".join(f"CAST(floor(1000 * (len(t) - len(replace(t, '{c}', ''))) / greatest(len(t), 1)) AS DOUBLE)" for c in LETTERS)}] AS embedding, year(o_orderdate) AS period
  FROM (SELECT doc_id, translate(coalesce(text, ''), '{LETTERS.upper()}', '{LETTERS}') AS t FROM documents) LEFT JOIN orders ON doc_id = o_orderkey)"""
