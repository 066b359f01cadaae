"""Queries over posts and activity: features, volume, engagement, authors, periods, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COMMUNITY_GROUPS
from ..functions import features as X
from ..operators import periods as T
from ..operators import search as R
from ..operators import stats as S
from .inputs import ACTIVITY, NOISY, POSTS, activity, noisy_comments, posts, table

#: Periods over the span of the orders, overlapping once: (name, start, end).
PERIODS = [("rise", "1995-03-01", "1995-09-30"), ("peak", "1996-11-01", "1997-04-30 23:59:59"), ("split", "1997-04-01", "1997-12-31"), ("late", "2000-01-01", "2000-06-30")]
TAG = "CASE WHEN ts BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-06-30' THEN 'late' WHEN ts BETWEEN TIMESTAMP '1997-04-01' AND TIMESTAMP '1997-12-31' THEN 'split' WHEN ts BETWEEN TIMESTAMP '1996-11-01' AND TIMESTAMP '1997-04-30 23:59:59' THEN 'peak' WHEN ts BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-09-30' THEN 'rise' ELSE 'Normal' END"
WINDOWS = [("first", "2024-01-03", "2024-01-12"), ("second", "2024-01-20", "2024-02-05")]
EVENTS = [("first", "2024-01-05", "one"), ("first", "2024-01-11", "two"), ("second", "2024-02-03", "three")]
r = lambda c, n=4: F.round(c, n)


def rounded(df, *cols, n=4):
    return df.withColumns({c: F.round(c, n) for c in cols})


def monthly_volume(spark, d):
    p = posts(spark, d).withColumns({"year_month": F.date_format("ts", "yyyy-MM"), "period": T.period_tag(F.col("ts"), PERIODS)})
    g = p.groupBy("year_month", "period").agg(F.count("*").alias("n"))
    return rounded(S.with_share(g, "n", ("year_month",)), "share")


def date_parts(spark, d):
    return X.with_date_parts(posts(spark, d), "ts").select("id", "year", "month", "day", "hour", "dayofweek", "date", "year_month", X.season(F.col("month")).alias("season"), X.is_weekend(F.col("ts")).alias("weekend"), X.quarter_label(F.col("ts")).alias("quarter"))


def engagement_features(spark, d):
    return posts(spark, d).select("id", r(X.engagement_ratio(F.col("score"), F.col("num_comments")), 8).alias("ratio"), r(F.col("score") + F.col("num_comments")).alias("total"), r(X.log_clip(F.col("score"))).alias("log_score"))


def region_counts(spark, d):
    g = posts(spark, d).select(X.region(F.col("subreddit"), ["1-urgent", "2-high"]).alias("region")).groupBy("region").agg(F.count("*").alias("n"))
    return rounded(S.with_share(g), "share")


def group_dim_join(spark, d):
    groups = spark.createDataFrame([("1-urgent", "hot"), ("2-high", "hot"), ("5-low", "cold")], "subreddit string, grp string")
    return posts(spark, d).join(F.broadcast(groups), "subreddit", "left").groupBy(F.coalesce("grp", F.lit("other")).alias("grp")).agg(F.count("*").alias("n"))


def nation_region(spark, d):
    n, g, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.countDistinct("n_name").alias("nations"))


def overview_stats(spark, d):
    o = S.overview(posts(spark, d)).withColumn("days", S.span_days(F.col("first_at"), F.col("last_at")))
    return rounded(o, "avg_score", "avg_comments", n=4).withColumn("total_engagement", F.round("total_engagement", 2))


def community_stats(spark, d):
    return rounded(S.community_stats(posts(spark, d)), "avg_score", "median_score", "avg_comments").withColumn("total_score", F.round("total_score", 2))


def temporal_counts(spark, d):
    return S.temporal_counts(activity(spark, d), "ts")


def yearly_full_outer(spark, d):
    a = posts(spark, d).groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("submissions"))
    b = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("comments"))
    return a.join(b, "year", "full_outer").na.fill(0)


def engagement_stats(spark, d):
    return rounded(S.engagement(posts(spark, d)), "score_mean", "score_median", "score_max", "score_p95", "comments_mean", "comments_median")


def engagement_percentiles(spark, d):
    return rounded(S.percentiles(posts(spark, d), ["score", "num_comments"]), "value")


def score_histogram(spark, d):
    return rounded(S.histogram(posts(spark, d), X.log_clip(F.col("score")), 50), "lo", "hi")


def author_overview(spark, d):
    return rounded(S.author_overview(noisy_comments(spark, d).withColumn("author", F.when(F.col("author") == "[deleted]", F.col("author")).otherwise(F.col("conv_id").cast("string")))), "mean_posts", "median_posts")


def author_activity_hist(spark, d):
    return S.activity_histogram(posts(spark, d))


def cross_community_authors(spark, d):
    return S.communities_per_author(posts(spark, d))


def top_authors(spark, d):
    return S.top(S.author_counts(posts(spark, d)), 15, "n", "author")


def top_posts(spark, d):
    return S.top(posts(spark, d).select("id", "subreddit", "score"), 10, "score", "id")


def top_months(spark, d):
    return S.top(posts(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("n")), 10, "n", "year_month")


def author_engagement(spark, d):
    p = posts(spark, d)
    t = S.top(S.author_counts(p), 10, "n", "author")
    return rounded(p.join(F.broadcast(t), "author").groupBy("author").agg(F.first("n").alias("n"), F.avg("score").alias("avg_score"), F.avg("num_comments").alias("avg_comments")), "avg_score", "avg_comments")


def season_peak(spark, d):
    g = posts(spark, d).groupBy(X.season(F.month("ts")).alias("season")).agg(F.count("*").alias("n"))
    return S.peak(g, "season")


def month_of_year(spark, d):
    cal = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    g = activity(spark, d).groupBy(F.month("ts").alias("month")).agg(F.count("*").alias("n"))
    return T.gap_filled(g, "month", cal)


def monthly_with_mean(spark, d):
    from pyspark.sql import Window

    g = posts(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("n"))
    return g.withColumn("mean", F.round(F.avg("n").over(Window.partitionBy()), 4))


def top_community_series(spark, d):
    p = posts(spark, d)
    return S.ordered_cross_table(p.withColumn("year_month", F.date_format("ts", "yyyy-MM")), "year_month", "subreddit", 5)


def crisis_tag(spark, d):
    dim = spark.createDataFrame([(n, s, e, i) for i, (n, s, e) in enumerate(PERIODS)], "name string, start string, end string, ord int")
    dim = dim.withColumns({"start": F.col("start").cast("timestamp"), "end": F.col("end").cast("timestamp")})
    return T.tag_periods(posts(spark, d), dim, "ts").select("id", "period")


def crisis_counts(spark, d):
    p = posts(spark, d).withColumn("period", T.period_tag(F.col("ts"), PERIODS)).filter("period <> 'Normal'")
    return p.groupBy("period").agg(F.count("*").alias("n"))


def crisis_engagement(spark, d):
    p = posts(spark, d).withColumn("period", T.period_tag(F.col("ts"), PERIODS))
    return rounded(p.groupBy("period").agg(F.avg("score").alias("avg_score"), F.avg("num_comments").alias("avg_comments")), "avg_score", "avg_comments").withColumn("ord", (F.col("period") != "Normal").cast("int"))


def crisis_by_community(spark, d):
    p = posts(spark, d).withColumn("period", T.period_tag(F.col("ts"), PERIODS)).filter("period <> 'Normal'")
    return rounded(S.row_shares(p, "period", "subreddit"), "share")


def timeline_gapfilled(spark, d):
    return T.timelines(activity(spark, d), WINDOWS, "ts")


def timeline_stats(spark, d):
    return rounded(T.timeline_stats(T.timelines(activity(spark, d), WINDOWS, "ts")), "mean_per_day")


def timeline_events(spark, d):
    return T.with_events(T.timelines(activity(spark, d), WINDOWS, "ts"), EVENTS)


def monthly_windows(spark, d):
    return T.window_counts(posts(spark, d), T.monthly_windows(spark, "1995-01-15", "1995-12-31"), "ts")


def hourly_stats(spark, d):
    w = T.hourly_windows(spark, "2024-01-02 00:00:00", "2024-01-04 12:30:00").select("window_start")
    a = activity(spark, d).filter("ts >= '2024-01-02' and ts < '2024-01-04 12:30:00'").groupBy(F.window("ts", "1 hour")["start"].alias("window_start")).agg(F.count("*").alias("n"), F.countDistinct("subreddit").alias("communities"))
    return T.gap_filled(a, "window_start", w).withColumn("communities", F.coalesce("communities", F.lit(0).cast("long")))


def daily_windows(spark, d):
    w = T.daily_windows(spark, "2024-01-01", "2024-01-31").select("window_start")
    a = activity(spark, d).groupBy(F.date_trunc("day", "ts").alias("window_start")).agg(F.count("*").alias("n"))
    return T.gap_filled(a, "window_start", w)


def event_alignment_7d(spark, d):
    a = activity(spark, d)
    ev = a.filter("subreddit = 'purchase'").groupBy(F.date_trunc("day", "ts").alias("event_ts")).agg(F.max("score").alias("s")).select(F.date_format("event_ts", "yyyy-MM-dd").alias("event_id"), "event_ts", F.lit("click").alias("keyword"))
    return T.align_events(a, ev, "ts", "subreddit").groupBy("event_id").agg(F.count("*").alias("n"))


def resume_anti_join(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return R.without_done(posts(spark, d), done).groupBy("subreddit").agg(F.count("*").alias("n"))


def comment_worklist(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return R.comment_worklist(posts(spark, d), done, 4).select("id", "num_comments")


def shard_completeness(spark, d):
    done = posts(spark, d).join(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct(), "id", "left_semi")
    return R.shard_completeness(posts(spark, d), done, "subreddit", 4)


def collected_posts(spark, d):
    """Overlapping fortnight windows: a post in two is kept once, from the first, with both windows' queries."""
    a = activity(spark, d).withColumn("week", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7))
    two = a.withColumn("window_start", F.explode(F.array(F.col("week") - 1, F.col("week")))).withColumn("_matched_queries", F.array(F.concat(F.lit("w"), F.col("window_start") % 2), F.col("subreddit")))
    return R.collected(two).select("id", "window_start", F.array_join("_matched_queries", "|").alias("queries"))


def shard_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


def seeded_sample(spark, d):
    return S.seeded_sample(posts(spark, d), 200, "id").select("id")


def sorted_periods(spark, d):
    p = posts(spark, d)
    one = lambda g: p.select(F.lit(g).alias("granularity"), X.period_label(F.col("ts"), g).alias("period"))
    return one("month").union(one("quarter")).union(one("year")).dropna().distinct()


def dedup_first_wins(spark, d):
    from ..sources.archive import deduplicated

    t = table(spark, d, "documents").select(F.md5("text").alias("_id"), F.col("doc_id").alias("_source"))
    return deduplicated(t, "first").select(F.col("_id").alias("key"), F.col("_source").alias("doc_id"))


def dedup_last_wins(spark, d):
    from ..sources.archive import deduplicated

    t = table(spark, d, "documents").select(F.md5("text").alias("_id"), F.col("doc_id").alias("_source"))
    return deduplicated(t, "last").select(F.col("_id").alias("key"), F.col("_source").alias("doc_id"))


def share_of_groups(spark, d):
    """Communities of two group dimensions, the configured one and one over the given sources, with their shares."""
    dims = COMMUNITY_GROUPS | {"low": ["SRC0", "src1", "Src2"], "teen": [f"src{i}" for i in range(10, 20)]}
    dim = spark.createDataFrame([(s.lower(), g) for g, ss in dims.items() for s in ss], "subreddit string, grp string")
    p = table(spark, d, "documents").select(F.lower("source").alias("subreddit"))
    return rounded(S.with_share(p.join(F.broadcast(dim), "subreddit", "left").groupBy(F.coalesce("grp", F.lit("none")).alias("grp")).agg(F.count("*").alias("n"))), "share")


def peaks(spark, d):
    """Season, month, weekday or weekend, and hour with the most activity."""
    a = activity(spark, d)
    of = {"season": X.season(F.month("ts")), "month": F.date_format("ts", "MM"), "weekend": F.when(X.is_weekend(F.col("ts")), "weekend").otherwise("weekday"), "hour": F.format_string("%02d", F.hour("ts"))}
    long = a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("what"), c.alias("key")) for k, c in of.items()]))).groupBy("what", "key").agg(F.count("*").alias("n"))
    best = long.groupBy("what").agg(F.min(F.struct((-F.col("n")).alias("m"), "key")).alias("b"))
    return best.select("what", "b.key", (-F.col("b.m")).alias("n"))


def score_comments_sample(spark, d):
    return S.seeded_sample(posts(spark, d).filter("score > 0"), 500, "id").select("id", r(X.log_clip(F.col("score"))).alias("log_score"), "num_comments")


def ordered_communities(spark, d):
    """Communities in the order of their totals, the order of a chart's columns."""
    p = posts(spark, d)
    return spark.createDataFrame([(i, c) for i, c in enumerate(S.top_values(p, "subreddit", 5))], "place int, subreddit string").join(p.groupBy("subreddit").agg(F.count("*").alias("n")).hint("shuffle_hash"), "subreddit")


def period_filter(spark, d):
    from ..functions.predicates import in_period

    return posts(spark, d).filter(in_period(F.col("ts"), "1996-01-01", "1996-06-30")).groupBy("subreddit").agg(F.count("*").alias("n"))


P, A = f"WITH {POSTS} ", f"WITH {ACTIVITY} "
ROUND = lambda c, n=4: f"round({c}, {n}) AS {c}"
_LINES = f"""{A}, w(wname, s, e) AS (VALUES ('first', DATE '2024-01-03', DATE '2024-01-12'), ('second', DATE '2024-01-20', DATE '2024-02-05')),
days AS (SELECT wname, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date FROM w),
lines AS (SELECT days.wname AS wname, days.date AS date, count(id) AS n FROM days LEFT JOIN activity ON CAST(ts AS DATE) = days.date GROUP BY 1, 2) """
DONE = "done AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')"

QUERIES = {
    "monthly_volume": (monthly_volume, f"{P}, g AS (SELECT strftime(ts, '%Y-%m') AS year_month, {TAG} AS period, count(*) AS n FROM posts GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY year_month), 4) AS share FROM g"),
    "date_parts": (date_parts, f"{P} SELECT id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS dayofweek, CAST(ts AS DATE) AS date, strftime(ts, '%Y-%m') AS year_month, CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring' WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season, isodow(ts) > 5 AS weekend, concat(year(ts), 'Q', quarter(ts)) AS quarter FROM posts"),
    "engagement_features": (engagement_features, f"{P} SELECT id, round(num_comments / (score + 1), 8) AS ratio, round(score + num_comments, 4) AS total, round(log10(greatest(score, 1.0)), 4) AS log_score FROM posts"),
    "region_counts": (region_counts, f"{P}, g AS (SELECT CASE WHEN subreddit IN ('1-urgent', '2-high') THEN 'Venezuela' ELSE 'US/English' END AS region, count(*) AS n FROM posts GROUP BY 1) SELECT *, round(n / sum(n) OVER (), 4) AS share FROM g"),
    "group_dim_join": (group_dim_join, f"{P} SELECT CASE WHEN subreddit IN ('1-urgent', '2-high') THEN 'hot' WHEN subreddit = '5-low' THEN 'cold' ELSE 'other' END AS grp, count(*) AS n FROM posts GROUP BY 1"),
    "nation_region": (nation_region, "SELECT r_name, count(*) AS n, count(DISTINCT n_name) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "overview_stats": (overview_stats, f"{P} SELECT count(id) AS posts, count(DISTINCT subreddit) AS communities, count(DISTINCT author) AS authors, min(ts) AS first_at, max(ts) AS last_at, round(avg(score), 4) AS avg_score, round(avg(num_comments), 4) AS avg_comments, round(sum(score) + sum(num_comments), 2) AS total_engagement, CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT) AS days FROM posts"),
    "community_stats": (community_stats, f"{P} SELECT subreddit, count(id) AS posts, count(DISTINCT author) AS authors, round(avg(score), 4) AS avg_score, round(median(score), 4) AS median_score, round(sum(score), 2) AS total_score, round(avg(num_comments), 4) AS avg_comments, CAST(sum(num_comments) AS BIGINT) AS total_comments FROM posts GROUP BY 1"),
    "temporal_counts": (temporal_counts, f"{A}, t AS (SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour FROM activity) SELECT year, month, dow, hour, count(*) AS n FROM t GROUP BY GROUPING SETS ((year), (year, month), (dow), (hour))"),
    "yearly_full_outer": (yearly_full_outer, f"{P}, a AS (SELECT CAST(year(ts) AS INT) AS year, count(*) AS submissions FROM posts GROUP BY 1), b AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS comments FROM lineitem GROUP BY 1) SELECT year, coalesce(submissions, 0) AS submissions, coalesce(comments, 0) AS comments FROM a FULL JOIN b USING (year)"),
    "engagement_stats": (engagement_stats, f"{P} SELECT round(avg(score), 4) AS score_mean, round(median(score), 4) AS score_median, round(max(score), 4) AS score_max, round(quantile_cont(score, 0.95), 4) AS score_p95, round(avg(num_comments), 4) AS comments_mean, round(median(num_comments), 4) AS comments_median, CAST(sum(num_comments) AS BIGINT) AS comments_sum, max(num_comments) AS comments_max FROM posts"),
    "engagement_percentiles": (engagement_percentiles, f"{P}, q(p) AS (VALUES (CAST(0.5 AS DOUBLE)), (0.75), (0.9), (0.95), (0.99)), v AS (SELECT quantile_cont(score, [0.5, 0.75, 0.9, 0.95, 0.99]) AS s, quantile_cont(CAST(num_comments AS DOUBLE), [0.5, 0.75, 0.9, 0.95, 0.99]) AS c FROM posts), o AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM q) SELECT 'score' AS metric, p, round(s[i], 4) AS value FROM o, v UNION ALL SELECT 'num_comments', p, round(c[i], 4) FROM o, v"),
    "score_histogram": (score_histogram, f"{P}, x AS (SELECT log10(greatest(score, 1.0)) AS x FROM posts), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x), h AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 50)) AS INT) + 1, 50) AS bin, count(*) AS n FROM x, e GROUP BY 1), b AS (SELECT CAST(unnest(range(1, 51)) AS INT) AS bin) SELECT bin, round(lo + (hi - lo) / 50 * (bin - 1), 4) AS lo, round(lo + (hi - lo) / 50 * bin, 4) AS hi, coalesce(n, 0) AS n FROM b CROSS JOIN e LEFT JOIN h USING (bin)"),
    "author_overview": (author_overview, f"WITH {NOISY}, c AS (SELECT CASE WHEN author = '[deleted]' THEN author ELSE CAST(conv_id AS VARCHAR) END AS author, count(*) AS n FROM noisy GROUP BY 1), k AS (SELECT n FROM c WHERE author <> '[deleted]') SELECT (SELECT count(*) FROM c) AS authors, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE author = '[deleted]') AS deleted_posts, round(avg(n), 4) AS mean_posts, round(median(n), 4) AS median_posts, max(n) AS max_posts FROM k"),
    "author_activity_hist": (author_activity_hist, f"{P}, c AS (SELECT author, count(*) AS n FROM posts GROUP BY 1) SELECT CASE WHEN n >= 100 THEN 100 WHEN n >= 50 THEN 50 WHEN n >= 20 THEN 20 WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 5 WHEN n >= 2 THEN 2 ELSE 1 END AS from_posts, count(*) AS authors FROM c GROUP BY 1"),
    "cross_community_authors": (cross_community_authors, f"{P}, c AS (SELECT author, count(DISTINCT subreddit) AS communities FROM posts GROUP BY 1) SELECT communities, count(*) AS authors FROM c GROUP BY 1"),
    "top_authors": (top_authors, f"{P} SELECT author, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, author LIMIT 15"),
    "top_posts": (top_posts, f"{P} SELECT id, subreddit, score FROM posts ORDER BY score DESC, id LIMIT 10"),
    "top_months": (top_months, f"{P} SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, year_month LIMIT 10"),
    "author_engagement": (author_engagement, f"{P}, t AS (SELECT author, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, author LIMIT 10) SELECT author, any_value(n) AS n, round(avg(score), 4) AS avg_score, round(avg(num_comments), 4) AS avg_comments FROM posts JOIN t USING (author) GROUP BY 1"),
    "season_peak": (season_peak, f"{P}, g AS (SELECT CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring' WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season, count(*) AS n FROM posts GROUP BY 1) SELECT season, n FROM g ORDER BY n DESC, season LIMIT 1"),
    "month_of_year": (month_of_year, f"{A}, m AS (SELECT CAST(unnest(range(1, 13)) AS INT) AS month) SELECT m.month, count(id) AS n FROM m LEFT JOIN activity ON month(ts) = m.month GROUP BY 1"),
    "monthly_with_mean": (monthly_with_mean, f"{P}, g AS (SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS n FROM posts GROUP BY 1) SELECT *, round(avg(n) OVER (), 4) AS mean FROM g"),
    "top_community_series": (top_community_series, f"""{P} SELECT strftime(ts, '%Y-%m') AS year_month, count(*) FILTER (subreddit = '1-urgent') AS "1-urgent", count(*) FILTER (subreddit = '2-high') AS "2-high", count(*) FILTER (subreddit = '3-medium') AS "3-medium", count(*) FILTER (subreddit LIKE '4-%') AS "4-not specified", count(*) FILTER (subreddit = '5-low') AS "5-low" FROM posts GROUP BY 1"""),
    "crisis_tag": (crisis_tag, f"{P} SELECT id, {TAG} AS period FROM posts"),
    "crisis_counts": (crisis_counts, f"{P} SELECT {TAG} AS period, count(*) AS n FROM posts GROUP BY 1 HAVING {TAG} <> 'Normal'".replace(f"HAVING {TAG} <> 'Normal'", "HAVING period <> 'Normal'")),
    "crisis_engagement": (crisis_engagement, f"{P} SELECT {TAG} AS period, round(avg(score), 4) AS avg_score, round(avg(num_comments), 4) AS avg_comments, CASE WHEN {TAG} <> 'Normal' THEN 1 ELSE 0 END AS ord FROM posts GROUP BY 1, 4"),
    "crisis_by_community": (crisis_by_community, f"{P}, g AS (SELECT {TAG} AS period, subreddit, count(*) AS n FROM posts GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY period), 4) AS share FROM g WHERE period <> 'Normal'"),
    "timeline_gapfilled": (timeline_gapfilled, f'{_LINES} SELECT wname AS "window", date, n FROM lines'),
    "timeline_stats": (timeline_stats, f'{_LINES} SELECT wname AS "window", CAST(sum(n) AS BIGINT) AS total, max(n) AS peak, arg_max(date, (n, -epoch(date))) AS peak_date, round(avg(n), 4) AS mean_per_day FROM lines GROUP BY 1'),
    "timeline_events": (timeline_events, f"""{_LINES}, e(wname, date, event) AS (VALUES ('first', DATE '2024-01-05', 'one'), ('first', DATE '2024-01-11', 'two'), ('second', DATE '2024-02-03', 'three')) SELECT wname AS "window", date, event, coalesce(n, 0) AS n FROM e LEFT JOIN lines USING (wname, date)"""),
    "monthly_windows": (monthly_windows, f"{P}, s AS (SELECT CAST(unnest(generate_series(DATE '1995-01-15', DATE '1995-12-30', INTERVAL 1 MONTH)) AS DATE) AS window_start), w AS (SELECT window_start, CAST(coalesce(lead(window_start) OVER (ORDER BY window_start) - 1, DATE '1995-12-31') AS DATE) AS window_end FROM s) SELECT window_start, window_end, count(*) AS n FROM w JOIN posts ON CAST(ts AS DATE) BETWEEN window_start AND window_end GROUP BY 1, 2"),
    "hourly_stats": (hourly_stats, f"{A}, w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04 12:29:59', INTERVAL 1 HOUR)) AS window_start) SELECT window_start, count(id) AS n, count(DISTINCT subreddit) AS communities FROM w LEFT JOIN (SELECT * FROM activity WHERE ts < TIMESTAMP '2024-01-04 12:30:00') a ON date_trunc('hour', ts) = window_start GROUP BY 1"),
    "daily_windows": (daily_windows, f"{A}, w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS window_start) SELECT window_start, count(id) AS n FROM w LEFT JOIN activity ON date_trunc('day', ts) = window_start GROUP BY 1"),
    "event_alignment_7d": (event_alignment_7d, f"{A}, ev AS (SELECT DISTINCT date_trunc('day', ts) AS event_ts FROM activity WHERE subreddit = 'purchase') SELECT strftime(event_ts, '%Y-%m-%d') AS event_id, count(*) AS n FROM activity JOIN ev ON ts >= event_ts AND ts <= event_ts + INTERVAL 7 DAY WHERE subreddit LIKE '%click%' GROUP BY 1"),
    "resume_anti_join": (resume_anti_join, f"{P}, {DONE} SELECT subreddit, count(*) AS n FROM posts ANTI JOIN done USING (id) GROUP BY 1"),
    "comment_worklist": (comment_worklist, f"{P}, {DONE} SELECT id, num_comments FROM posts ANTI JOIN done USING (id) WHERE num_comments >= 4"),
    "shard_completeness": (shard_completeness, f"{P}, {DONE} SELECT e.subreddit, eligible, coalesce(processed, 0) AS processed, coalesce(processed, 0) >= eligible AS complete FROM (SELECT subreddit, count(*) AS eligible FROM posts WHERE num_comments >= 4 GROUP BY 1) e LEFT JOIN (SELECT subreddit, count(DISTINCT id) AS processed FROM posts SEMI JOIN done USING (id) GROUP BY 1) p USING (subreddit)"),
    "collected_posts": (collected_posts, f"{A}, t AS (SELECT id, subreddit, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS week FROM activity) SELECT id, week - 1 AS window_start, array_to_string(list_sort(list_distinct([concat('w', (week - 1) % 2), concat('w', week % 2), subreddit])), '|') AS queries FROM t"),
    "shard_counts": (shard_counts, "SELECT source, count(*) AS n FROM documents GROUP BY 1"),
    "seeded_sample": (seeded_sample, f"{P} SELECT id FROM posts ORDER BY md5('42:' || id), id LIMIT 200"),
    "peaks": (peaks, f"{A}, l AS (SELECT unnest([{{'what': 'season', 'key': CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring' WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END}}, {{'what': 'month', 'key': strftime(ts, '%m')}}, {{'what': 'weekend', 'key': CASE WHEN isodow(ts) > 5 THEN 'weekend' ELSE 'weekday' END}}, {{'what': 'hour', 'key': strftime(ts, '%H')}}], recursive := true) FROM activity) SELECT what, key, count(*) AS n FROM l GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY what ORDER BY n DESC, key) = 1"),
    "score_comments_sample": (score_comments_sample, f"{P} SELECT id, round(log10(greatest(score, 1.0)), 4) AS log_score, num_comments FROM posts WHERE score > 0 ORDER BY md5('42:' || id), id LIMIT 500"),
    "ordered_communities": (ordered_communities, f"{P}, g AS (SELECT subreddit, count(*) AS n FROM posts GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n DESC, subreddit) - 1 AS INT) AS place, subreddit, n FROM g"),
    "period_filter": (period_filter, f"{P} SELECT subreddit, count(*) AS n FROM posts WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1996-06-30' GROUP BY 1"),
    "sorted_periods": (sorted_periods, f"{P} SELECT DISTINCT 'month' AS granularity, strftime(ts, '%Y-%m') AS period FROM posts UNION SELECT 'quarter', concat(year(ts), 'Q', quarter(ts)) FROM posts UNION SELECT 'year', strftime(ts, '%Y') FROM posts"),
    "dedup_first_wins": (dedup_first_wins, "SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1"),
    "dedup_last_wins": (dedup_last_wins, "SELECT md5(text) AS key, max(doc_id) AS doc_id FROM documents GROUP BY 1"),
    "share_of_groups": (share_of_groups, "WITH g AS (SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'low' WHEN source LIKE 'src1_' THEN 'teen' ELSE 'none' END AS grp, count(*) AS n FROM documents GROUP BY 1) SELECT *, round(n / sum(n) OVER (), 4) AS share FROM g"),
}
