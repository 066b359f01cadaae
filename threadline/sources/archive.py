"""Keyed-JSON archives, Parquet and CSV tables: scans and sinks.

A shard is one JSON object a file, {id: {fields}}; keys that start with `_`
are metadata. A shard that is indented by two blanks, as `save_shards` writes
it, is read by many tasks: the end of an item at that depth cannot occur within
one, so it serves as the record separator of Spark's text reader, which finds
the next one after any byte. A shard in another layout is one record, below 2 GB.
What does not parse is salvaged item by item, and what cannot be salvaged is
dropped.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.text import strip

SUBMISSION = (
    "id string, title string, selftext string, author string, subreddit string, created_utc string, score bigint, num_comments bigint, url string, "
    "_matched_queries array<string>, _window_start string, _window_end string, _granularity string, _collection_type string, _window string, _crisis boolean, _crisis_name string"
)
COMMENT = (
    "id string, body string, author string, subreddit string, created_utc string, score bigint, link_id string, parent_id string, controversiality int, is_submitter boolean, "
    "distinguished string, edited string, permalink string, _submission_id string, _submission_title string, _submission_score bigint, _depth int, _is_top_level boolean, _parent_comment_id string"
)


#: The end of an item of an indented shard. Strings hold no line breaks, and what is deeper has more blanks.
ITEM_END = "\n  },"
#: Pairs "id": {...} with one nested level at most; possessive, as the matcher otherwise keeps a frame for every character.
PIECE = r'"([a-z0-9]+)"\s*:\s*(\{(?:[^{}]++|\{[^{}]*+\})*+\})'


def items_of(records: DataFrame, schema: str, salvage: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row an item of the records of shards (`value`): _id and the fields."""
    kind = f"map<string, struct<{ddl(schema)}>>"
    parsed = lambda c: F.from_json(c, kind, {"mode": "PERMISSIVE"})
    body = F.regexp_replace("value", r"^\s*\{?", "")
    # the last item of a shard (or a whole one) closes the object; the others' ends went with the separator
    m = F.coalesce(parsed(F.concat(F.lit("{"), body)), parsed(F.concat(F.lit("{"), body, F.lit("}}"))))
    tagged = records.filter(F.trim(body) != "").select(*keep, "value", F.map_filter(m, lambda k, v: v.isNotNull()).alias("m"))
    whole = tagged.filter("m is not null").select(*keep, F.explode("m").alias("_id", "v"))
    if salvage:
        bad = tagged.filter("m is null").select(*keep, F.explode(F.regexp_extract_all("value", F.lit(PIECE), F.lit(0))).alias("p"))
        whole = whole.unionAll(bad.select(*keep, F.explode(parsed(F.concat(F.lit("{"), F.col("p"), F.lit("}")))).alias("_id", "v")).filter("v is not null"))
    return whole.filter(~F.col("_id").startswith("_")).select("_id", *keep, "v.*")


def keyed_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json", without: tuple[str, ...] = (), salvage: bool = True) -> DataFrame:
    """A row an item: _id (its key), _source (its file), and the fields. Absent fields are null."""
    raw = spark.read.option("lineSep", ITEM_END).option("pathGlobFilter", glob).text(path)
    raw = raw.withColumn("_source", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))))  # names come percent-encoded
    for part in without:
        raw = raw.filter(~F.contains("_source", F.lit(part)))
    return items_of(raw, schema, salvage, ("_source",))


def ddl(schema: str) -> str:
    """`a int, b string` as struct fields."""
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in schema.split(", ")))


def deduplicated(df: DataFrame, keep: str = "none", key: str = "_id", order: str = "_source") -> DataFrame:
    """none: all rows; first or last: one row a key, by the order of files."""
    if keep == "none":
        return df
    w = Window.partitionBy(key).orderBy(F.col(order).desc() if keep == "last" else F.col(order).asc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def load_submissions(spark: SparkSession, path: str, glob: str = "*.json", dedup: str = "none", without: tuple[str, ...] = ("stats", "comments")) -> DataFrame:
    """Submissions with time parts, length and engagement features, lower-case community."""
    s = deduplicated(keyed_json(spark, path, SUBMISSION, glob, without), dedup)
    s = X.with_date_parts(s.withColumn("created_datetime", X.epoch_to_timestamp(F.col("created_utc"))), "created_datetime")
    s = X.text_features(s, "title", "title")
    return s.withColumns({
        "engagement_ratio": X.engagement_ratio(F.col("score"), F.col("num_comments")), "total_engagement": F.col("score") + F.col("num_comments"), "subreddit": F.lower("subreddit"),
    })


def load_comments(spark: SparkSession, path: str, glob: str = "*comments*.json", dedup: str = "none") -> DataFrame:
    """Comments with time parts, lengths, numeric `edited` and blanked nullable strings."""
    c = deduplicated(keyed_json(spark, path, COMMENT, glob), dedup)
    c = c.withColumn("created_datetime", X.epoch_to_timestamp(F.col("created_utc"))).withColumn("edited", X.edited_at(F.col("edited")))
    c = c.withColumns({k: X.blank(F.col(k)) for k in ("distinguished", "_parent_comment_id", "permalink")})
    c = c.withColumns({"year": F.year("created_datetime"), "date": F.to_date("created_datetime"), "hour": F.hour("created_datetime")})
    return c.withColumns({"comment_length": X.text_length(F.col("body")), "word_count": X.word_count(F.col("body"))})


def as_corpus(df: DataFrame, kind: str, text: Column) -> DataFrame:
    """The unified columns; rows whose text is empty or a deletion marker go."""
    d = df.withColumns({"type": F.lit(kind), "text": strip(F.coalesce(text, F.lit(""))), "subreddit": F.lower("subreddit"), "score": F.coalesce("score", F.lit(0))})
    d = d.filter(~F.col("text").isin("", "[deleted]", "[removed]"))
    if "created_datetime" not in d.columns:
        d = d.withColumn("created_datetime", X.epoch_to_timestamp(F.col("created_utc")))
    return d.withColumns({
        "year": F.year("created_datetime"), "month": F.month("created_datetime"), "year_month": F.date_format("created_datetime", "yyyy-MM"), "date": F.to_date("created_datetime"),
    })


def unified(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    return submissions.unionByName(comments, allowMissingColumns=True)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Raw submissions and comments of a folder as one corpus; order it where it is written."""
    s = keyed_json(spark, path, SUBMISSION, "*_filtered.json", ("comments", "stats"))
    c = keyed_json(spark, path, COMMENT, "comments_*.json")
    c = c.withColumn("submission_id", X.submission_of(F.col("link_id"), F.col("_submission_id")))
    return unified(as_corpus(s, "submission", X.full_text(F.col("title"), F.col("selftext"))), as_corpus(c, "comment", F.col("body")))


def load_all(spark: SparkSession, raw: str, submissions: str | None = None, comments: str | None = None, use_clean: bool = True) -> DataFrame:
    """The cleaned tables where both are there and wanted, else the raw folder; in the order of time within partitions."""
    def there(path: str | None) -> bool:
        if not path:
            return False
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    d = load_clean(spark, submissions, comments) if use_clean and there(submissions) and there(comments) else load_corpus(spark, raw)
    return in_time_order(d)


def in_time_order(df: DataFrame, ts: str = "created_datetime") -> DataFrame:
    """Ranges of time as partitions, each sorted: files written from it are in the order of time."""
    return df.repartitionByRange(F.col(ts).asc_nulls_last()).sortWithinPartitions(F.col(ts).asc_nulls_last())


def load_posts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet posts table with time, date, year, month and region."""
    p = spark.read.parquet(path).withColumn("created_datetime", X.epoch_to_timestamp(F.col("created_utc")))
    return p.withColumns({"date": F.to_date("created_datetime"), "year": F.year("created_datetime"), "month": F.month("created_datetime"), "region": X.region(F.col("subreddit"))})


def load_clean(spark: SparkSession, submissions: str, comments: str) -> DataFrame:
    s = spark.read.parquet(submissions)
    c = spark.read.parquet(comments)
    return unified(as_corpus(s, "submission", F.col("full_text")), as_corpus(c, "comment", F.col("body_clean")))


def save_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """parquet (snappy), csv with a header, or JSON lines."""
    w = df.write.mode(mode).partitionBy(*partition_by)
    {"parquet": lambda: w.option("compression", "snappy").parquet(path), "csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path)}[fmt]()


def save_shards(df: DataFrame, path: str, shard: str = "_shard", key: str = "_id") -> None:
    """Keyed-JSON shards {id: {fields}}, a file `<shard>.json` for each value of the shard column, ids in their order.

    A shard's items are sorted and streamed to its file, so that no task holds
    an object. All files are written aside and committed by Spark; only then
    each takes its name, so what fails before leaves nothing to be read.
    """
    spark = df.sparkSession
    name = F.to_json(F.array(F.col(key).cast("string")))
    fields = F.to_json(F.struct(*[c for c in df.columns if c not in (key, shard)]))
    w = Window.partitionBy(shard).orderBy("_k", "_fields")
    rows = df.select(F.col(shard).cast("string").alias(shard), F.col(key).cast("string").alias("_k"), F.expr("1").alias("_one"), F.substring(name, 2, 1 << 20).alias("_name"), fields.alias("_fields"))
    first, last = F.lag("_one").over(w).isNull(), F.lead("_one").over(w).isNull()
    item = F.concat(F.when(first, "{\n").otherwise(""), F.lit("  "), F.col("_name").substr(F.lit(1), F.length("_name") - 1), F.lit(": "), F.col("_fields").substr(F.lit(1), F.length("_fields") - 1), F.when(last, "\n  }\n}").otherwise(ITEM_END))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}/_aside-{uuid.uuid4().hex}"  # readers pass over names like this
    try:
        rows.select(shard, item.alias("value")).write.partitionBy(shard).option("lineSep", "\n").text(aside)
        for f in fs.globStatus(fs_path(f"{aside}/{shard}=*/part-*")):
            to = fs_path(f"{path}/{unquote(f.getPath().getParent().getName().split('=', 1)[1])}.json")
            fs.delete(to, False)
            fs.rename(f.getPath(), to)
    finally:
        fs.delete(fs_path(aside), True)


def save_results(tables: dict[str, DataFrame], path: str, fmt: dict[str, str] | str = "parquet", partition_by: dict[str, tuple[str, ...]] | None = None) -> None:
    """A folder a table; fmt and partition_by can be given by name."""
    for name, t in tables.items():
        save_table(t, f"{path}/{name}", fmt if isinstance(fmt, str) else fmt.get(name, "parquet"), (partition_by or {}).get(name, ()))


def load_all_results(spark: SparkSession, path: str, formats: dict[str, str]) -> dict[str, DataFrame]:
    return {name: load_results(spark, f"{path}/{name}", fmt) for name, fmt in formats.items()}


def load_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)


def save_embeddings(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding") -> None:
    df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding"), *[c for c in df.columns if c not in (id_col, vec_col)]).write.mode("overwrite").parquet(path)


def embeddings_of(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """A row for each id asked for; an unknown one has a null embedding."""
    return ids.select(id_col).distinct().join(store, id_col, "left")


def ids_at(index: DataFrame, places: DataFrame, place: str = "embedding_idx", id_col: str = "id") -> DataFrame:
    """A row for each place asked for, with its id; an unknown one has none."""
    return places.select(place).distinct().join(index.select(place, id_col), place, "left")


def members(labels: DataFrame, cluster, cluster_col: str = "cluster_id", id_col: str = "id") -> DataFrame:
    """Ids of one cluster."""
    return labels.filter(F.col(cluster_col) == cluster).select(id_col)
