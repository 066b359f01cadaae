"""Queries over files: the given tables are written as archives, tables and reports, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..sources import archive as A
from ..sources.shared import folder
from ..streaming import streams as Z
from . import sqltext as Q
from .inputs import NOISY, POSTS, noisy_comments, posts, table

#: Shards a source; so a shard of any size of the tables fits a task.
PIECES = 16


def _archive(spark, d):
    """Documents as submission shards and conversation turns as comment shards."""
    path = folder(spark, "archive")
    t = table(spark, d, "documents")
    digest = F.md5("text")
    s = t.select(
        F.concat(F.col("source"), F.lit("_"), F.pmod(F.col("doc_id"), F.lit(PIECES)), F.lit("_filtered")).alias("_shard"), F.concat(F.lit("p"), F.col("doc_id")).alias("_id"),
        F.concat(F.lit("p"), F.col("doc_id")).alias("id"), digest.alias("title"), F.col("text").alias("selftext"), F.upper("lang").alias("subreddit"), (F.lit(1704067200) + F.col("doc_id") * 3600).alias("created_utc"),
        (F.col("doc_id") % 50).alias("score"), F.col("n_chars").alias("num_comments"),
    )
    A.save_shards(s, f"{path}/posts")
    n = noisy_comments(spark, d)
    c = n.select(
        F.concat(F.lit("comments_"), F.pmod(F.col("conv_id"), F.lit(PIECES))).alias("_shard"), F.concat(F.lit("c"), F.col("id")).alias("_id"), F.col("id").cast("string").alias("id"), "body", "author",
        (F.lit(1704067200) + F.col("id") * 60).alias("created_utc"), F.concat(F.lit("t3_p"), F.col("conv_id")).alias("link_id"), F.when(F.col("turn") % 2 == 0, "false").otherwise("1704067200").alias("edited"), F.when(F.col("turn") % 3 == 0, "None").alias("distinguished"),
    )
    A.save_shards(c, f"{path}/comments")
    return path


def archive_submissions(spark, d):
    s = A.load_submissions(spark, _archive(spark, d) + "/posts", "*_filtered.json", "last")
    return s.select("_id", "_source", "title", "subreddit", "year", "hour", "date", "year_month", "total_engagement", F.round("engagement_ratio", 8).alias("ratio"), F.col("title_length").cast("long").alias("title_length"))


def archive_comments(spark, d):
    c = A.load_comments(spark, _archive(spark, d) + "/comments")
    return c.select("_id", "_source", F.md5("body").alias("body_md5"), "edited", "distinguished", F.col("comment_length").cast("long").alias("comment_length"), F.col("word_count").cast("long").alias("word_count"), "date")


def archive_salvage(spark, d):
    """Shards whose end is cut off: all items but the last are read."""
    path = folder(spark, "cut")
    t = table(spark, d, "documents")
    A.save_shards(t.select(F.concat(F.lit("s"), F.pmod(F.col("doc_id"), F.lit(PIECES))).alias("_shard"), F.concat(F.lit("p"), F.col("doc_id")).alias("_id"), F.repeat(F.md5("text"), F.lit(40)).alias("selftext"), F.array(F.lit("q")).alias("_matched_queries")), path)
    cut = spark.read.text(path, wholetext=True).select(F.expr("substring(value, 1, length(value) - 9)").alias("value"), F.col("_metadata.file_name").alias("shard"))
    cut.write.partitionBy("shard").text(path + "-2")  # a file a shard
    k = A.keyed_json(spark, path + "-2", A.SUBMISSION, "*.txt")
    return k.select("_id", F.md5("selftext").alias("digest"), F.col("_matched_queries")[0].alias("query"))


def corpus_table(spark, d):
    """Raw shards as one corpus, with the parts that mark its rows."""
    path = _archive(spark, d)
    c = A.in_time_order(A.unified(A.as_corpus(A.keyed_json(spark, path + "/posts", A.SUBMISSION, "*_filtered.json", ("comments", "stats")), "submission", F.col("title")), A.as_corpus(A.keyed_json(spark, path + "/comments", A.COMMENT, "comments_*.json"), "comment", F.col("body"))))
    return c.select("_id", "type", F.md5("text").alias("text_md5"), "year_month", "date", "score")


def clean_or_raw(spark, d):
    """The cleaned tables where they are, else the raw shards: counts of both ways."""
    from .pipelines import run_clean

    path = _archive(spark, d)
    spark_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = spark_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in ("posts", "comments"):
        for f in fs.listStatus(spark_path(f"{path}/{part}")):
            if f.getPath().getName().endswith(".json"):
                fs.rename(f.getPath(), spark_path(f"{path}/{f.getPath().getName()}"))
    run_clean(spark, path, path + "/clean")
    of = lambda df, how: df.groupBy("type").agg(F.count("*").alias("n"), F.count("submission_id").alias("linked")).withColumn("way", F.lit(how))
    raw = A.load_all(spark, path, path + "/none", path + "/none")
    clean = A.load_all(spark, path, path + "/clean/submissions", path + "/clean/comments").withColumn("submission_id", F.lit(None).cast("string"))
    return of(raw, "raw").unionByName(of(clean, "clean")).filter("type = 'comment' or way = 'raw'")


def table_formats(spark, d):
    """A report's tables to Parquet, CSV and JSON lines, and back."""
    path = folder(spark, "results")
    p = posts(spark, d)
    of = {"by_year": p.groupBy(F.year("ts").alias("k")), "by_community": p.groupBy(F.col("subreddit").alias("k")), "by_month": p.groupBy(F.date_format("ts", "yyyy-MM").alias("k"))}
    tables = {k: g.agg(F.count("*").alias("n"), F.sum("num_comments").alias("comments")) for k, g in of.items()}
    fmt = {"by_year": "csv", "by_month": "json"}
    A.save_results(tables, path, fmt)
    back = {"by_year": A.load_results(spark, f"{path}/by_year", "csv"), "by_community": A.load_results(spark, f"{path}/by_community"), "by_month": spark.read.json(f"{path}/by_month")}
    out = None
    for name, t in back.items():
        t = t.select(F.lit(name).alias("name"), F.col("k").cast("string").alias("k"), F.col("n").cast("long").alias("n"), F.col("comments").cast("long").alias("comments"))
        out = t if out is None else out.unionByName(t)
    return out


def partitioned_export(spark, d):
    """Posts by year as folders; a year is read without the others."""
    path = folder(spark, "posts")
    p = posts(spark, d).select("id", "subreddit", F.unix_timestamp("ts").alias("created_utc"), F.year("ts").alias("y"))
    A.save_table(p, path, partition_by=("y",))
    return A.load_posts(spark, path).filter("y = 1996").groupBy("region", "month").agg(F.count("*").alias("n"))


def embedding_store(spark, d):
    path = folder(spark, "vectors")
    e = table(spark, d, "embeddings")
    A.save_embeddings(e.select(F.col("vec_id").alias("id"), "embedding", "label"), path)
    s = spark.read.parquet(path)
    return s.select("id", "label", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def stream_new_shards(spark, d):
    """Shards as a stream, run twice over one folder: the second run reads only the shards that came after the first."""
    path, base = folder(spark, "shards"), folder(spark, "newshards")
    s = table(spark, d, "documents").select(
        F.concat(F.lit("half"), F.col("doc_id") % 2, F.lit("_"), F.pmod(F.floor(F.col("doc_id") / 2), F.lit(PIECES))).alias("_shard"), F.concat(F.lit("p"), F.col("doc_id")).alias("_id"),
        F.upper("lang").alias("subreddit"), (F.col("doc_id") % 50).alias("score"), F.col("doc_id").alias("_doc"),
    )
    runs = []
    for half in range(2):
        A.save_shards(s.filter(F.col("_doc") % 2 == half).drop("_doc"), path)
        z = Z.stream_posts(spark, path, A.SUBMISSION).select("_id", "subreddit", "score")
        Z.run_available(z, base + "/out", base + "/checkpoint")
        runs.append(spark.read.schema(z.schema).parquet(base + "/out").count())
    out = spark.read.schema(z.schema).parquet(base + "/out").groupBy("subreddit").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return out.withColumns({"after_first": F.lit(runs[0]).cast("long"), "after_second": F.lit(runs[1]).cast("long")})


def report_top(spark, d):
    """A report's ranked table with a preview of the text."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"), F.substring("text", 1, 30).alias("preview"))
    return S.top(t, 30, "n", "id")


_S = "WITH s AS (SELECT *, 'p' || doc_id AS pid, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS ts FROM documents)"
_C = f"WITH {NOISY}, c AS (SELECT *, 'c' || id AS cid, TIMESTAMP '2024-01-01' + to_minutes(CAST(id AS INT)) AS ts FROM noisy)"
_OK = " AND ".join(f"NOT {c}" for c in Q.reasons("author", "body").values())

QUERIES = {
    "archive_submissions": (archive_submissions, f"{_S} SELECT pid AS _id, source || '_' || (doc_id % {PIECES}) || '_filtered.json' AS _source, md5(text) AS title, lower(lang) AS subreddit, CAST(year(ts) AS INT) AS year, CAST(hour(ts) AS INT) AS hour, CAST(ts AS DATE) AS date, strftime(ts, '%Y-%m') AS year_month, doc_id % 50 + n_chars AS total_engagement, round(n_chars / (doc_id % 50 + 1), 8) AS ratio, len(md5(text)) AS title_length FROM s"),
    "archive_comments": (archive_comments, f"{_C} SELECT cid AS _id, 'comments_' || (conv_id % {PIECES}) || '.json' AS _source, md5(body) AS body_md5, CASE WHEN turn % 2 = 0 THEN 0.0 ELSE CAST(1704067200 AS DOUBLE) END AS edited, '' AS distinguished, len(body) AS comment_length, {Q.words('body')} AS word_count, CAST(ts AS DATE) AS date FROM c"),
    "archive_salvage": (archive_salvage, f"SELECT 'p' || doc_id AS _id, md5(repeat(md5(text), 40)) AS digest, 'q' AS query FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % {PIECES} ORDER BY 'p' || doc_id DESC) > 1"),
    "corpus_table": (corpus_table, f"{_C} SELECT cid AS _id, 'comment' AS type, md5({Q.strip('body')}) AS text_md5, strftime(ts, '%Y-%m') AS year_month, CAST(ts AS DATE) AS date, CAST(0 AS BIGINT) AS score FROM c WHERE {Q.strip('body')} NOT IN ('', '[deleted]', '[removed]') UNION ALL SELECT 'p' || doc_id, 'submission', md5(md5(text)), strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)), '%Y-%m'), CAST(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS DATE), doc_id % 50 FROM documents"),
    "clean_or_raw": (clean_or_raw, f"{_C}, k AS (SELECT {Q.clean('body')} AS b FROM c WHERE {_OK}) SELECT 'submission' AS type, count(*) AS n, CAST(0 AS BIGINT) AS linked, 'raw' AS way FROM documents UNION ALL SELECT 'comment', count(*), count(*), 'raw' FROM c WHERE {Q.strip('body')} NOT IN ('', '[deleted]', '[removed]') UNION ALL SELECT 'comment', count(*), 0, 'clean' FROM k WHERE {Q.words('b')} >= 5"),
    "table_formats": (table_formats, f"WITH {POSTS} SELECT 'by_year' AS name, CAST(year(ts) AS VARCHAR) AS k, count(*) AS n, CAST(sum(num_comments) AS BIGINT) AS comments FROM posts GROUP BY 2 UNION ALL SELECT 'by_community', subreddit, count(*), CAST(sum(num_comments) AS BIGINT) FROM posts GROUP BY 2 UNION ALL SELECT 'by_month', strftime(ts, '%Y-%m'), count(*), CAST(sum(num_comments) AS BIGINT) FROM posts GROUP BY 2"),
    "partitioned_export": (partitioned_export, f"WITH {POSTS} SELECT 'US/English' AS region, CAST(month(ts) AS INT) AS month, count(*) AS n FROM posts WHERE year(ts) = 1996 GROUP BY 2"),
    "embedding_store": (embedding_store, "SELECT vec_id AS id, label, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings"),
    "stream_new_shards": (stream_new_shards, "SELECT upper(lang) AS subreddit, count(*) AS n, CAST(sum(doc_id % 50) AS BIGINT) AS score, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS after_first, (SELECT count(*) FROM documents) AS after_second FROM documents GROUP BY 1"),
    "report_top": (report_top, "SELECT doc_id AS id, len(text) AS n, substr(text, 1, 30) AS preview FROM documents ORDER BY n DESC, id LIMIT 30"),
}
