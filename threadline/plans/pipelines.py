"""End-to-end runs made of the operators: cleaning, analysis, sentiment, topics, clusters, summaries, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMMUNITIES, CRISIS_COMMUNITIES, CRISIS_QUERIES, KEYWORD_GROUPS, PERIODS, PRIORITY_QUERIES, TIMELINE_EVENTS, TIMELINE_WINDOWS, TOPIC_TERMS
from ..functions import features as X
from ..functions import predicates as P
from ..functions import text as U
from ..operators import clean as C
from ..operators import clusters as K
from ..operators import density as D
from ..operators import periods as T
from ..operators import search as R
from ..operators import sentiment as N
from ..operators import stats as S
from ..operators import terms as W
from ..operators import topics as O
from ..operators import vectors as V
from ..sources import archive as A
from ..sources.shared import written

#: The named periods with their ends as dates alone, so that the last day counts to midnight only, as where they come from.
TAGS = [(name, start[:10], end[:10]) for _, name, start, end, _ in PERIODS]


def run_clean(spark: SparkSession, source: str, out: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Last-wins scans, valid rows with clean text to `out`, and the reports on what was dropped."""
    s = A.load_submissions(spark, source, "*_filtered.json", "last")
    c = A.load_comments(spark, source, "comments_*.json", "last")
    A.save_table(C.clean_submissions(s), f"{out}/submissions", fmt)
    A.save_table(C.clean_comments(c), f"{out}/comments", fmt)
    return {
        "comment_reasons": C.reason_counts(c), "comment_first_reasons": C.first_reason_counts(c),
        "submission_retention": C.retention(s, P.valid_submission(F.col("author"), F.col("title"), F.col("selftext"))),
        "comment_retention": C.retention(c, P.valid_comment(F.col("author"), F.col("body"))),
    }


def run_export(spark: SparkSession, source: str, out: str) -> None:
    A.save_table(A.load_submissions(spark, source), f"{out}/submissions")
    A.save_table(A.load_comments(spark, source), f"{out}/comments")


def analysis_tables(posts: DataFrame, ts: str = "created_datetime", text: str = "title") -> dict[str, DataFrame]:
    """The tables of the summary report and of its charts, each lazy over one posts table."""
    p = posts.withColumns({"ts": F.col(ts), "period": T.period_tag(F.col(ts), TAGS), "year_month": F.date_format(ts, "yyyy-MM")})
    lines = T.timelines(p, TIMELINE_WINDOWS, "ts")
    return {
        "overview": S.overview(p), "communities": S.community_stats(p), "temporal": S.temporal_counts(p, "ts"), "engagement": S.engagement(p),
        "percentiles": S.percentiles(p, ["score", "num_comments"]), "score_histogram": S.histogram(p, X.log_clip(F.col("score"))), "comment_histogram": S.histogram(p, X.log_clip(F.col("num_comments"))),
        "authors": S.author_overview(p), "top_authors": S.top(S.author_counts(p.filter(P.not_author(F.col("author")))), 15, "n", "author"), "author_activity": S.activity_histogram(p),
        "communities_per_author": S.communities_per_author(p), "top_posts": S.top(p.select("id", text, "score"), 10, "score", "id"),
        "months": S.top(p.groupBy("year_month").agg(F.count("*").alias("n")), 10, "n", "year_month"), "seasons": p.groupBy(X.season(F.month("ts")).alias("season")).agg(F.count("*").alias("n")),
        "regions": S.with_share(p.groupBy(X.region(F.col("subreddit")).alias("region")).agg(F.count("*").alias("n"))),
        "periods": p.filter("period <> 'Normal'").groupBy("period").agg(F.count("*").alias("n")), "period_engagement": p.groupBy("period").agg(F.avg("score").alias("avg_score"), F.avg("num_comments").alias("avg_comments")),
        "period_communities": S.row_shares(p.filter("period <> 'Normal'"), "period", "subreddit"), "timelines": lines, "timeline_stats": T.timeline_stats(lines), "timeline_events": T.with_events(lines, TIMELINE_EVENTS),
        "keywords": W.keyword_coverage(p, KEYWORD_GROUPS, text), "topic_trend": W.topic_trend(p, TOPIC_TERMS, F.col("year_month"), text), "lexical": W.lexical_stats(p, text),
        "unigrams": W.top_terms(p, 1, 20, text), "bigrams": W.top_terms(p, 2, 15, text), "trigrams": W.top_terms(p, 3, 10, text),
        "community_words": W.panel_terms(p, "subreddit", 100, text, min_rows=20), "period_words": W.panel_terms(p.filter("period <> 'Normal'"), "period", 60, text, min_rows=50),
    }


def sentiment_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """Overall, by community, by month, and by both; texts are scored once, and the scores written."""
    scored = written(scored.select("subreddit", "year_month", "sentiment_label", "sentiment_score"), "scored")
    return {"summary": N.aggregate(scored), "by_community": N.aggregate(scored, "subreddit"), "by_month": N.aggregate(scored, "year_month"), "by_both": N.aggregate(scored, "subreddit", "year_month")}


def topic_tables(corpus: DataFrame, radius: float | list[float], **args) -> dict[str, DataFrame]:
    """Topics of a corpus (id, text, created_datetime, subreddit): documents, words, info, over time, by community."""
    docs, words = O.fit_topics(corpus, radius, **args)
    j = docs.drop("text").join(corpus.select("id", "created_datetime", "subreddit"), "id")
    return {
        "documents": docs, "words": words, "info": O.topic_info(docs, words), "over_time": O.topics_over_time(j.filter("topic_id <> -1"), "created_datetime"),
        "by_community": O.topics_by_group(j, "subreddit"), "representative": O.representative(docs), "table": topic_table(docs, words),
    }


def cluster_tables(corpus: DataFrame, radius: float | list[float], period: str = "year_month", **args) -> dict[str, DataFrame]:
    """Clusters of a corpus with embeddings: labels, summary, by period, evolution, flow, keywords, requests."""
    labels = D.hierarchical_clusters(corpus, radius, **args)
    c = corpus.join(labels, "id")
    words = W.cluster_keywords(c.filter("cluster_id <> -1"), "cluster_id", "id")
    evolution = K.evolution(c, period)
    summary = K.cluster_summary(c, ts="created_datetime")
    return {
        "labels": labels, "totals": K.totals(c), "summary": summary, "by_period": K.temporal_clusters(c, F.col(period)), "heatmap": K.heatmap(c, "subreddit"),
        "evolution": evolution, "flow": K.flow_edges(evolution), "keywords": words, "table": cluster_table(summary, words), "scatter": scatter(corpus, labels),
        "requests": K.summary_requests(K.sample_texts(c.filter("cluster_id <> -1")), summary),
    }


def scatter(corpus: DataFrame, labels: DataFrame, vec: str = "embedding", text: str = "text", chars: int = 100) -> DataFrame:
    """id, x, y, cluster_id, is_noise and a preview of the text: what a scatter chart shows of all clustered rows."""
    flat = V.reduce_dimensions(corpus.select("id", text, vec), 2, vec, "_xy")
    j = flat.join(labels.select("id", "cluster_id", "is_noise").hint("shuffle_hash"), "id")
    return j.select("id", F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"), "cluster_id", "is_noise", U.preview(F.col(text), chars).alias("preview"))


def cluster_table(summary: DataFrame, keywords: DataFrame, k: int = 30) -> DataFrame:
    """The k largest clusters with their figures and keywords in order, and a label."""
    words = keywords.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("keywords"))
    t = summary.join(words.hint("shuffle_hash"), "cluster_id", "left").withColumn("label", X.cluster_label(F.col("cluster_id"), F.col("top_community"), F.col("n")))
    return S.top(t, k, "n", "cluster_id")


def topic_table(docs: DataFrame, words: DataFrame, k: int = 30) -> DataFrame:
    """The k largest topics with their share of the documents, label and words; outliers are left out."""
    said = words.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("words"))
    info = S.with_share(O.topic_info(docs, words), "n").filter("topic_id <> -1")
    return S.top(info.join(said.hint("shuffle_hash"), "topic_id", "left"), k, "n", "topic_id")


def collect_historical(posts: DataFrame, start: str, end: str, communities: list[str] = COMMUNITIES, queries: list[str] = PRIORITY_QUERIES) -> DataFrame:
    """Posts of the listed communities that match a query, month by month, once each with their tags."""
    return R.collect_windows(posts, communities, T.monthly_windows(posts.sparkSession, start, end), queries, "monthly", "historical")


def collect_crisis(posts: DataFrame, key: str, communities: list[str] = CRISIS_COMMUNITIES, queries: list[str] = CRISIS_QUERIES) -> DataFrame:
    """The same for one named period, hour by hour."""
    start, end = next((s.replace("T", " "), e.replace("T", " ")) for k, _, s, e, _ in PERIODS if k == key)
    return R.collect_windows(posts, communities, T.hourly_windows(posts.sparkSession, start, end), queries, "hourly", "crisis")


def list_periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERIODS, "key string, name string, start string, end string, priority string").orderBy("start")
