"""Volume, engagement, author and community statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small, written


def overview(df: DataFrame, id="id", community="subreddit", author="author", ts="ts", score="score", comments="num_comments") -> DataFrame:
    """One row. Rows are summed up an author first, so that authors are counted without a second copy of the rows."""
    per = df.groupBy(author).agg(
        F.count(id).alias("i"), F.min(ts).alias("a"), F.max(ts).alias("b"), F.sum(score).alias("s"), F.count(score).alias("ns"), F.sum(comments).alias("c"), F.count(comments).alias("nc"),
    )
    mean = lambda x, n: F.try_divide(F.sum(x).cast("double"), F.sum(n))
    main = per.agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("posts"), F.count(author).alias("authors"), F.min("a").alias("first_at"), F.max("b").alias("last_at"),
        mean("s", "ns").alias("avg_score"), mean("c", "nc").alias("avg_comments"), (F.sum("s") + F.sum("c")).alias("total_engagement"),
    )
    communities = df.filter(F.col(community).isNotNull()).groupBy(community).agg(F.lit(1)).agg(F.count("*").alias("communities"))
    return main.crossJoin(F.broadcast(communities)).select("posts", "communities", *[c for c in main.columns if c != "posts"])  # a row each


def span_days(first: Column, last: Column) -> Column:
    return F.floor((F.unix_timestamp(last) - F.unix_timestamp(first)) / 86400)


def exact_percentiles(df: DataFrame, by: list[str], col: str, at: list[float]) -> DataFrame:
    """(by, p, value), exact with linear interpolation, however many values a group has.

    Equal values are counted first; the counts are dealt by ranges of (by, value)
    and written, each range sums up within itself, and the ranges' sums give
    where it starts. No task holds a group.
    """
    c = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    c = written(c.repartitionByRange(*by, "_v").sortWithinPartitions(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    parts = c.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_part")
    parts = parts.select(*by, "_part", (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(*by)).alias("_all"))
    same = None
    for k in [*by, "_part"]:
        e = F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = e if same is None else same & e
    inside = Window.partitionBy(*by, "_part").orderBy("_v")
    own = c.withColumn("_upto", F.sum("_n").over(inside))
    r = own.alias("c").join(small(parts).alias("s"), same).select(*[F.col(f"c.{k}").alias(k) for k in by], "_v", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_lo"), (F.col("_before") + F.col("_upto") - 1).alias("_hi"), "_all")
    r = r.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("_at", F.col("p") * (F.col("_all") - 1))
    on = lambda x: (x >= F.col("_lo")) & (x <= F.col("_hi"))
    r = r.filter(on(F.floor("_at")) | on(F.ceil("_at")))
    g = r.groupBy(*by, "p").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first(F.col("_at") - F.floor("_at")).alias("_f"))
    return g.select(*by, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value"))


def community_stats(df: DataFrame, by="subreddit", id="id", author="author", score="score", comments="num_comments") -> DataFrame:
    d = df.filter(F.col(by).isNotNull())
    per = d.groupBy(by, author).agg(F.count(id).alias("i"), F.sum(score).alias("s"), F.count(score).alias("ns"), F.sum(comments).alias("c"), F.count(comments).alias("nc"))
    main = per.groupBy(by).agg(
        F.sum("i").alias("posts"), F.count(author).alias("authors"), F.try_divide(F.sum("s").cast("double"), F.sum("ns")).alias("avg_score"),
        F.sum("s").alias("total_score"), F.try_divide(F.sum("c").cast("double"), F.sum("nc")).alias("avg_comments"), F.sum("c").alias("total_comments"),
    )
    median = exact_percentiles(d, [by], score, [0.5]).select(by, F.col("value").alias("median_score"))
    return main.join(median.hint("shuffle_hash"), by, "left").select(by, "posts", "authors", "avg_score", "median_score", "total_score", "avg_comments", "total_comments")


def temporal_counts(df: DataFrame, ts: str) -> DataFrame:
    """Counts by year, (year, month), weekday and hour from one scan: (year, month, dow, hour, n), null where not grouped by."""
    parts = df.filter(F.col(ts).isNotNull()).select(F.year(ts).alias("year"), F.month(ts).alias("month"), F.weekday(ts).alias("dow"), F.hour(ts).alias("hour"))
    y, m, d, h = (F.col(c) for c in ("year", "month", "dow", "hour"))
    return parts.groupingSets([[y], [y, m], [d], [h]], y, m, d, h).agg(F.count("*").alias("n"))


def with_share(df: DataFrame, value="n", within: tuple[str, ...] = (), name="share") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*within))))


def engagement(df: DataFrame, score="score", comments="num_comments") -> DataFrame:
    main = df.agg(F.avg(score).alias("score_mean"), F.max(score).alias("score_max"), F.avg(comments).alias("comments_mean"), F.sum(comments).alias("comments_sum"), F.max(comments).alias("comments_max"))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    s = exact_percentiles(df, [], score, [0.5, 0.95]).agg(at(0.5).alias("score_median"), at(0.95).alias("score_p95"))
    c = exact_percentiles(df, [], comments, [0.5]).agg(at(0.5).alias("comments_median"))
    return main.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(c))  # a row each


def percentiles(df: DataFrame, columns: list[str], at=(0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """(metric, p, value), exact with linear interpolation."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])))
    return exact_percentiles(long, ["metric"], "x", list(at))


def histogram(df: DataFrame, x: Column, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n): equal widths from minimum to maximum, which is in the last bin; bins without rows have 0."""
    v = df.select(x.alias("x")).filter("x is not null")
    ends = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width) + 1, F.lit(bins))).cast("int")
    n = v.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))  # one row of ends
    all_ = ends.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "hi")
    return all_.join(n.hint("shuffle_hash"), "bin", "left").select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("lo"), (F.col("lo") + width * F.col("bin")).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def author_counts(df: DataFrame, author="author") -> DataFrame:
    return df.filter(F.col(author).isNotNull()).groupBy(author).agg(F.count("*").alias("n"))


def author_overview(df: DataFrame, author="author", deleted: str = "[deleted]") -> DataFrame:
    c = author_counts(df, author)
    known = F.col(author).cast("string") != deleted
    return c.agg(
        F.count("*").alias("authors"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("deleted_posts"), F.avg(F.when(known, F.col("n"))).alias("mean_posts"),
        F.median(F.when(known, F.col("n"))).alias("median_posts"), F.max(F.when(known, F.col("n"))).alias("max_posts"),
    )


def activity_histogram(df: DataFrame, author="author", edges=(1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """Authors by their number of posts, in half-open bins from each edge to the next."""
    n, label = F.col("n"), F.lit(None).cast("int")
    for e in edges:
        label = F.when(n >= e, F.lit(e)).otherwise(label)
    return author_counts(df, author).groupBy(label.alias("from_posts")).agg(F.count("*").alias("authors"))


def communities_per_author(df: DataFrame, author="author", community="subreddit") -> DataFrame:
    per = df.filter(F.col(author).isNotNull()).groupBy(author).agg(F.countDistinct(community).alias("communities"))
    return per.groupBy("communities").agg(F.count("*").alias("authors"))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n largest, ties by the given columns."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def peak(df: DataFrame, key: str, value="n") -> DataFrame:
    """The key of the largest value, the earliest of several."""
    return df.agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("b")).select(F.col("b.k").alias(key), (-F.col("b.v")).alias(value))


def row_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, share in the row): the long form of a row-normalised cross table."""
    return with_share(df.groupBy(row, col).agg(F.count("*").alias("n")), "n", (row,))


def cross_table(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts with a column for each of the given values, 0 where there are none."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def top_values(df: DataFrame, col: str, n: int) -> list:
    """The n most frequent values, ties by value: n rows come to the driver, for a pivot's columns."""
    return [r[0] for r in df.filter(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(n).collect()]


def seeded_order(key: str, seed: int = 42) -> Column:
    """A seeded digest of a key: the same order every time and in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded digest: the same ones every time."""
    return df.orderBy(seeded_order(key, seed), key).limit(n)


def ordered_cross_table(df: DataFrame, row: str, col: str, n: int) -> DataFrame:
    """The n most frequent columns of a cross table, in the order of their totals."""
    return cross_table(df, row, col, top_values(df, col, n))
