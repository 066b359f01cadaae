"""Keyed-JSON scans: salvage, metadata keys, de-duplication, absent fields."""

import json

import pytest
from pyspark.sql import functions as F

from threadline.functions import features as X
from threadline.sources import archive as A


def test_keyed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x1": {"id": "x1", "title": "one", "score": 3, "created_utc": 1700000000}, "_meta": {"title": "no"}}))
    (tmp_path / "b.json").write_text('{"x1": {"id": "x1", "title": "newer", "created_utc": "bad"}, "x2": {"id": "x2", "title": "two"}, "x3": {"id": "x3", "ti')
    (tmp_path / "b_comments.json").write_text(json.dumps({"c": {"id": "c", "body": "b"}}))
    rows = A.load_submissions(spark, str(tmp_path)).select("_id", "_source", "title", "score", "year", "engagement_ratio").collect()
    assert sorted((r._id, r._source, r.title) for r in rows) == [("x1", "a.json", "one"), ("x1", "b.json", "newer"), ("x2", "b.json", "two")]
    last = A.load_submissions(spark, str(tmp_path), dedup="last")
    assert sorted((r._id, r.title) for r in last.collect()) == [("x1", "newer"), ("x2", "two")]
    com = A.load_comments(spark, str(tmp_path)).first()
    assert (com.body, com.edited, com.distinguished, com.word_count) == ("b", 0.0, "", 1)


def test_corpus_and_sinks(spark, tmp_path):
    (tmp_path / "s_filtered.json").write_text(json.dumps({"a": {"id": "a", "title": "t", "selftext": None, "created_utc": 0}, "b": {"id": "b", "title": "[removed]", "created_utc": 0}}))
    (tmp_path / "comments_s.json").write_text(json.dumps({"c": {"id": "c", "body": "hi", "link_id": "t3_a", "created_utc": 86400}}))
    c = A.load_corpus(spark, str(tmp_path))
    assert sorted((r.id, r.type, r.text, str(r.date), r.submission_id) for r in c.collect()) == [("a", "submission", "t", "1970-01-01", None), ("c", "comment", "hi", "1970-01-02", "a")]
    for fmt in ("parquet", "csv", "json"):
        A.save_table(c.select("id", "text"), str(tmp_path / fmt), fmt)
    assert A.load_results(spark, str(tmp_path / "csv"), "csv").count() == 2


def test_salvage_of_long_items(spark, tmp_path):
    """A cut shard with a long text and nested objects: the matcher must not need a frame a character."""
    text = r'long text, with: colons and \"quotes\" ' * 1100
    items = [f'"x{i}": {{"id": "x{i}", "selftext": "{text}", "extra": {{"a": 1, "b": [1, 2]}}, "title": "t{i}"}}' for i in range(3)]
    (tmp_path / "a.json").write_text("{" + ", ".join(items) + ', "x9": {"id": "x9", "selftext": "cut ')
    got = A.keyed_json(spark, str(tmp_path), A.SUBMISSION).select("_id", "title", "selftext").collect()
    assert sorted((r._id, r.title, len(r.selftext)) for r in got) == [(f"x{i}", f"t{i}", len(text.replace("\\", ""))) for i in range(3)]


def test_shards_round_trip(spark, tmp_path):
    rows = [("s1", "a", 'say "hi" {x}', 1), ("s1", "b", None, 2), ("s2", "c", "\n\t\u00e9", None)]
    A.save_shards(spark.createDataFrame(rows, "_shard string, _id string, title string, score long"), str(tmp_path / "x"))
    assert sorted(p.name for p in (tmp_path / "x").glob("*.json")) == ["s1.json", "s2.json"]
    got = A.keyed_json(spark, str(tmp_path / "x"), A.SUBMISSION).select("_source", "_id", "title", "score").collect()
    assert sorted((r._source[:-5], r._id, r.title, r.score) for r in got) == rows


def test_one_shard_is_read_by_many_tasks(spark, tmp_path):
    items = {f"x{i:04}": {"id": f"x{i}", "title": 'end },\n  }, "q": {' * (i % 3), "score": i, "_matched_queries": ["a", "b"] if i % 2 else None} for i in range(4000)}
    (tmp_path / "big.json").write_text(json.dumps(items, indent=2))
    (tmp_path / "flat.json").write_text(json.dumps({k: items[k] for k in list(items)[:50]}))
    (tmp_path / "cut.json").write_text(json.dumps({"_meta": {"title": "m"}, **items}, indent=2)[:200_000])
    (tmp_path / "none.json").write_text("{}")
    A.save_shards(spark.createDataFrame([("own 1+é", k, v["title"], v["score"]) for k, v in items.items()], "_shard string, _id string, title string, score long"), str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = A.keyed_json(spark, str(tmp_path), A.SUBMISSION).withColumn("part", F.spark_partition_id()).select("_source", "_id", "title", "score", "part").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in got:
        by.setdefault(r._source, {})[r._id] = (r.title, r.score)
    want = {k: (v["title"], v["score"]) for k, v in items.items()}
    assert by["big.json"] == want and by["own 1+é.json"] == want
    assert by["flat.json"] == {k: want[k] for k in list(want)[:50]} and by["cut.json"] == {k: want[k] for k in list(want)[: len(by["cut.json"])]} and 1000 < len(by["cut.json"]) < 4000
    assert len({r.part for r in got if r._source == "big.json"}) > 5 and len(got) == sum(map(len, by.values()))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 3}", f"a{i}", i) for i in range(90)], "_shard string, _id string, score long")
    with pytest.raises(Exception, match="no more"):
        A.save_shards(rows.withColumn("score", F.when(F.col("_id") == "a77", F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("score"))), str(tmp_path / "x"))
    assert not list((tmp_path / "x").rglob("*.json")) and not list((tmp_path / "x").glob("*"))
    A.save_shards(rows, str(tmp_path / "x"))
    assert sorted(p.name for p in (tmp_path / "x").glob("[!.]*")) == ["s0.json", "s1.json", "s2.json"]
    assert all(len(json.loads(p.read_text())) == 30 for p in (tmp_path / "x").glob("*.json"))


def test_time_order_and_types(spark, tmp_path):
    df = spark.range(500).selectExpr("timestamp_seconds((id * 7919) % 500) as created_datetime", "cast(id as string) as edited", "array(id) as tags", "named_struct('a', id) as s")
    A.in_time_order(df).write.parquet(str(tmp_path / "t"))
    parts = [[r[0] for r in spark.read.parquet(str(p)).select("created_datetime").collect()] for p in sorted((tmp_path / "t").glob("*.parquet"))]
    assert [x for p in parts for x in p] == sorted(x for p in parts for x in p)
    plain = X.plain_types(df)
    assert dict(plain.dtypes) == {"created_datetime": "timestamp", "edited": "double", "tags": "string", "s": "string"}
    odd = spark.createDataFrame([(None,), ("None",), ("nan",), ("ok",)], "x string")
    assert [r[0] for r in odd.select(X.blank(odd.x)).collect()] == ["", "", "", "ok"]
