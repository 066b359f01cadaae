"""The end-to-end runs on a tiny archive."""

import json

from pyspark.sql import functions as F

from threadline.operators import sentiment as N
from threadline.plans import pipelines as R
from threadline.sources import archive as A


def test_clean_and_analyse(spark, tmp_path):
    posts = {f"p{i}": {"id": f"p{i}", "title": f"Maduro oil news number {i} army", "selftext": "see https://a.b/c", "author": f"u{i % 3}", "subreddit": "Vzla", "created_utc": 1548000000 + i * 86400, "score": i, "num_comments": i % 4} for i in range(12)}
    posts["bot"] = {"id": "bot", "title": "rule 4 broken here", "author": "AutoModerator", "subreddit": "news", "created_utc": 1, "score": 0, "num_comments": 0}
    (tmp_path / "x_filtered.json").write_text(json.dumps(posts))
    (tmp_path / "comments_x.json").write_text(json.dumps({"c": {"id": "c", "body": "five words are right here", "author": "a"}, "d": {"id": "d", "body": "lol", "author": "a"}}))
    reports = R.run_clean(spark, str(tmp_path), str(tmp_path / "out"))
    assert reports["submission_retention"].first().kept == 12 and {r.reason: r.n for r in reports["comment_first_reasons"].collect()} == {"kept": 1, "too_short": 1}
    assert spark.read.parquet(str(tmp_path / "out/comments")).first().body_clean == "five words are right here"
    t = R.analysis_tables(A.load_submissions(spark, str(tmp_path)))
    assert {r.period for r in t["periods"].collect()} == {"Guaido Recognition Crisis"}
    assert {r.region: r.n for r in t["regions"].collect()} == {"Venezuela": 12, "US/English": 1}
    for name, df in t.items():
        assert df.columns, name
    assert t["timelines"].count() == 151 + 92 + 123 and R.list_periods(spark).count() == 10


def test_model_runs(spark, tmp_path):
    words = ["apple banana cherry grape", "engine wheel motor brake"]
    rows = [(i, words[i % 2] + f" w{i % 5}", f"2024-0{1 + i % 3}-01", "abc"[i % 3], "positive" if i % 2 else "neutral", (i % 2) / 2) for i in range(60)]
    c = spark.createDataFrame(rows, "id long, text string, d string, subreddit string, sentiment_label string, sentiment_score double").withColumns({"created_datetime": F.col("d").cast("timestamp"), "year_month": F.substring("d", 1, 7)})
    t = R.sentiment_tables(c)
    assert t["summary"].first().total == 60 and t["by_both"].count() == 3 and sum(r.total for r in t["by_month"].collect()) == 60
    topics = R.topic_tables(c, 0.3, min_topic_size=5, min_samples=3, reduce_to=2)
    assert topics["documents"].count() == 60 and sum(r.n for r in topics["info"].collect()) == 60 and topics["over_time"].count() > 0 and topics["by_community"].count() > 0
    e = c.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.1))))
    k = R.cluster_tables(e, 0.3, min_size=5, min_samples=3)
    assert k["totals"].first().clusters == 2 and k["requests"].count() == 2 and {r.similarity > 0.99 for r in k["evolution"].collect()} == {True}
    table = {r.cluster_id: r for r in k["table"].collect()}
    assert {r.n for r in table.values()} == {30} and {w for r in table.values() for w in r.keywords.split(", ")} >= {"apple", "engine"}
    dots = k["scatter"].collect()
    assert len(dots) == 60 and {r.preview.split(" ")[0] for r in dots} == {"apple", "engine"} and len({(round(r.x, 6), round(r.y, 6)) for r in dots}) == 2
    assert sum(r.n for r in topics["table"].collect()) == topics["documents"].filter("topic_id <> -1").count()
    A.save_results(t | {"topics": topics["info"]}, str(tmp_path / "r"), {"summary": "csv"}, {"by_both": ("year_month",)})
    back = A.load_all_results(spark, str(tmp_path / "r"), {"summary": "csv", "by_both": "parquet"})
    assert back["summary"].count() == 1 and back["by_both"].filter("year_month = '2024-02'").count() == 1


def test_collections_by_default_lists(spark):
    rows = [(1, "Maduro and Venezuela", "venezuela", "2019-01-25 10:30:00"), (2, "Maduro", "cats", "2019-01-25 10:30:00"), (3, "weather", "venezuela", "2019-01-25 10:30:00"), (4, "venezuela oil", "vzla", "2019-03-01 00:00:00")]
    p = spark.createDataFrame(rows, "id int, text string, subreddit string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    h = {r.id: r for r in R.collect_historical(p, "2019-01-01", "2019-04-01").collect()}
    assert set(h) == {1, 4} and h[1]._matched_queries == ["Maduro", "Venezuela"] and h[1]._granularity == "monthly" and str(h[4]._window_start)[:7] == "2019-03"
    c = R.collect_crisis(p, "guaido_recognition_2019").collect()
    assert [(r.id, str(r._window_start)[:13], r._collection_type) for r in c] == [(1, "2019-01-25 10", "crisis")]


def test_export(spark, tmp_path):
    (tmp_path / "x_filtered.json").write_text(json.dumps({"a": {"id": "a", "title": "t", "created_utc": 5}}))
    (tmp_path / "comments_x.json").write_text(json.dumps({"c": {"id": "c", "body": "b", "created_utc": 5}}))
    R.run_export(spark, str(tmp_path), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/submissions")).first().title == "t" and spark.read.parquet(str(tmp_path / "out/comments")).count() == 1


def test_sentiment_tables_score_texts_once(spark):
    label, confidence = N.lexicon_score(F.col("text"), ["good"], ["bad"])
    rows = spark.createDataFrame([(1, "good good", "a", "2024-01"), (2, "bad", "a", "2024-02"), (3, None, "b", "2024-01")], "id int, text string, subreddit string, year_month string")
    t = R.sentiment_tables(N.score_sentiment(rows, label, confidence))
    assert all("regexp_replace" not in x._jdf.queryExecution().toString() for x in t.values())
    assert {r.subreddit: (r.total, r.positive_count, r.negative_count) for r in t["by_community"].collect()} == {"a": (2, 1, 1), "b": (1, 0, 0)}
