"""Queries over what is kept between runs: progress of shards, sketches, tables stored by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as K
from ..sources import bucketed as B
from ..sources.shared import discard, folder, written
from ..streaming import progress as G
from ..streaming import streams as Z
from .inputs import ACTIVITY, POSTS, activity, posts, table


def stream_completeness(spark, d):
    """Months of orders as shards, run in two halves over one checkpoint; done are the orders with a finished small line item. The last row of a shard is its state."""
    p = posts(spark, d).select(F.date_format("ts", "yyyy-MM").alias("shard"), "id", "num_comments", "ts")
    done = table(spark, d, "lineitem").filter("l_linestatus = 'F' AND l_quantity < 30").select(F.col("l_orderkey").alias("id")).distinct()
    p = written(p.join(done.withColumn("done", F.lit(True)).hint("shuffle_hash"), "id", "left").withColumn("half", F.col("id") % 2 == 0), "orders", by="half")  # the tables are joined once for both halves
    end = p.agg((F.max("ts") + F.expr("interval 9000 days")).alias("ts")).select(F.lit("end").alias("shard"), F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("num_comments"), "ts")
    base, halves = folder(spark, "progress"), (F.col("half"), ~F.col("half"))
    for half in halves:
        new = p.filter(half).select("shard", "id", "num_comments", "ts")
        (new.unionByName(end) if half is halves[1] else new).write.mode("append").parquet(base + "/posts")
        p.filter(half & F.col("done")).select("shard", "id", "ts").write.mode("append").parquet(base + "/done")
        s = G.stream_completeness(Z.stream_table(spark, base + "/posts"), Z.stream_table(spark, base + "/done"), 3, "10 days", "3000 days")
        Z.run_available(s, base + "/out", base + "/checkpoint")
    discard(p)
    out = spark.read.schema(G.OUT).parquet(base + "/out")
    return out.groupBy("shard").agg(F.max(F.struct("n", "eligible", "processed", "complete")).alias("x")).select("shard", "x.eligible", "x.processed", "x.complete")


def sketch_counts(spark, d):
    """Authors a community and day, rolled up to days, communities and all, from sketches kept in two halves; with the exact counts."""
    a = activity(spark, d).withColumn("day", F.to_date("ts"))
    path, by = folder(spark, "sketches"), ["subreddit", "day"]
    K.distinct_sketches(a.filter(F.col("id") % 2 == 0), by, "author").write.parquet(path)
    s = K.refreshed(spark.read.parquet(path), a.filter(F.col("id") % 2 != 0), by, "author")
    out = None
    for level in (["subreddit", "day"], ["day"], ["subreddit"], []):
        e = K.estimates(K.rolled_up(s, level), "estimate")
        x = a.groupBy(*level).agg(F.countDistinct("author").alias("authors"))
        j = e.join(x.hint("shuffle_hash"), level) if level else e.crossJoin(F.broadcast(x))  # one row each
        t = j.select(F.col("subreddit") if "subreddit" in level else F.lit(None).cast("string").alias("subreddit"), F.col("day") if "day" in level else F.lit(None).cast("date").alias("day"), "rows", "authors", (F.abs(F.col("estimate") - F.col("authors")) <= K.error_bound() * F.col("authors")).alias("within"))
        out = t if out is None else out.unionByName(t)
    return out


def bucketed_resume(spark, d):
    """Posts without a returned item, from two tables stored by id: no shuffle."""
    work = B.save_bucketed(posts(spark, d), folder(spark, "work"), buckets=16)
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    left = B.still_to_do(work, B.save_bucketed(done, folder(spark, "done"), buckets=16))
    return left.select("id", "subreddit", "num_comments")


def bucketed_lookup(spark, d):
    """Vectors of all documents from a store kept by id; unknown ids have none."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    store = B.save_bucketed(e, folder(spark, "store"), buckets=16)
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return B.looked_up(ids, store).select("id", F.size("embedding").alias("dim"))


_LEVEL = "SELECT {}, count(*) AS rows, count(DISTINCT author) AS authors, true AS within FROM a GROUP BY ALL"

QUERIES = {
    "stream_completeness": (stream_completeness, f"WITH {POSTS}, x AS (SELECT strftime(ts, '%Y-%m') AS shard, num_comments >= 3 AS wanted, id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 30) AS done FROM posts) SELECT shard, count(*) FILTER (wanted) AS eligible, count(*) FILTER (done) AS processed, processed >= eligible AS complete FROM x GROUP BY 1 HAVING count(*) FILTER (wanted) > 0"),
    "sketch_counts": (sketch_counts, f"WITH {ACTIVITY}, a AS (SELECT subreddit, CAST(ts AS DATE) AS day, author FROM activity) " + " UNION ALL ".join(_LEVEL.format(c) for c in ("subreddit, day", "NULL AS subreddit, day", "subreddit, NULL AS day")) + " UNION ALL SELECT NULL, NULL, count(*), count(DISTINCT author), true FROM a"),
    "bucketed_resume": (bucketed_resume, f"WITH {POSTS} SELECT id, subreddit, num_comments FROM posts WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "bucketed_lookup": (bucketed_lookup, "SELECT doc_id AS id, len(embedding) AS dim FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN embeddings ON doc_id = vec_id"),
}
