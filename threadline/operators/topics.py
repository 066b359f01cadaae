"""Topics: vectors, density clusters, class-based term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, small, written
from .density import hierarchical_clusters
from .merging import merged_topics
from .stats import with_share
from .terms import class_tfidf, gram_rows, top_class_terms, top_per, words_of
from .vectors import centroids, cosine, embed, reduce_dimensions


def fit_topics(df: DataFrame, radius: float | list[float], min_topic_size: int = 10, min_samples: int = 5, reduce_to: int = 5, id="id", text="text", n_topics: int | None = None, grams: tuple[int, ...] = (1, 2), rerank: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with topic_id, topic_prob, topic_label; words of topics): -1 are outliers. Texts are cut into terms once."""
    t = written(df.select(F.col(id).alias("id"), F.col(text).alias("text"), words_of(df, text).alias("terms")), "terms")
    e = written(embed(t, "terms"), "embedded")
    discard(t)
    d = reduce_dimensions(e, reduce_to).select("id", "text", "terms", "reduced")
    c = hierarchical_clusters(d.select("id", "reduced"), radius, min_topic_size, min_samples, vec="reduced")
    j = d.join(c.hint("shuffle_hash"), "id").select("id", "text", "terms", F.col("cluster_id").alias("topic_id"), F.col("cluster_prob").alias("topic_prob"))
    j = written(j, "topics")
    if n_topics is not None:
        j = written(merged_topics(j, n_topics, text="terms"), "topics")
    words = written(top_class_terms(j.filter("topic_id <> -1"), "topic_id", 30 if rerank else 10, "terms", min_df=2, grams=grams), "words")
    if rerank:
        words = written(reranked(words.drop("rank"), j, e.select("id", "embedding"), text="terms"), "words")
    return j.drop("terms").join(small(topic_labels(words)), "topic_id", "left"), words


def reranked(words: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 10, topic: str = "topic_id", text: str = "text") -> DataFrame:
    """The candidate words of topics (topic, term, weight) by likeness: a term is the mean vector of the topic's documents with it, compared with the topic's mean."""
    v = docs.filter(F.col(topic) != -1).join(vectors.hint("shuffle_hash"), "id")
    c = written(centroids(v, topic).select(topic, F.col("centroid")), "centroids")
    said = docs.filter(F.col(topic) != -1).select(topic, "id", words_of(docs, text).alias("words"))
    with_term = None
    for n in (1, 2):  # rows of the candidates only, before they are made distinct
        names = [f"w{i}" for i in range(n)]
        parts = F.split("term", " ")
        some = small(words.filter(F.size(parts) == n).select(topic, "term", *[parts[i].alias(w) for i, w in enumerate(names)]))
        rows = gram_rows(said, n, (topic, "id")).join(some, [topic, *names]).select(topic, "id", "term")
        with_term = rows if with_term is None else with_term.unionByName(rows)
    with_term = with_term.distinct().join(vectors.hint("shuffle_hash"), "id")
    t = centroids(with_term, topic, "term").select(topic, "term", F.col("centroid").alias("term_vector"))
    j = t.join(small(c), topic).join(small(words), [topic, "term"])
    return top_per(j.select(topic, "term", "weight", cosine(F.col("term_vector"), F.col("centroid")).alias("similarity")), topic, "similarity", k)


def save_topics(docs: DataFrame, words: DataFrame, path: str) -> None:
    """A topic model as two Parquet tables."""
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    words.write.mode("overwrite").parquet(f"{path}/words")


def load_topics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/words")


def topic_labels(words: DataFrame, n: int = 4, topic="topic_id") -> DataFrame:
    """id_word_word_word_word."""
    top = words.filter(F.col("rank") <= n).groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
    return top.select(topic, F.concat_ws("_", F.col(topic).cast("string"), F.transform("w", lambda x: x["term"])).alias("topic_label"))


def topic_info(docs: DataFrame, words: DataFrame, topic="topic_id") -> DataFrame:
    return docs.groupBy(topic).agg(F.count("*").alias("n")).join(small(topic_labels(words, topic=topic)), topic, "left")


def topics_by_group(docs: DataFrame, group: str, topic="topic_id") -> DataFrame:
    return with_share(docs.groupBy(group, topic).agg(F.count("*").alias("n")), "n", (group,))


def with_time_bins(docs: DataFrame, ts: str, bins: int = 30) -> DataFrame:
    """Adds bin (1 ...): equal widths over the whole range; the last moment is in the last bin; rows without a time go."""
    t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    ends = docs.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    d = docs.filter(F.col(ts).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    b = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.floor((t - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) + 1, F.lit(bins))).cast("int")
    return d.withColumn("bin", b).drop("_lo", "_hi")


def topics_over_time(docs: DataFrame, ts: str, bins: int = 30, topic="topic_id") -> DataFrame:
    """(bin, topic, n)."""
    return with_time_bins(docs, ts, bins).groupBy("bin", topic).agg(F.count("*").alias("n"))


def words_over_time(docs: DataFrame, ts: str, bins: int = 30, k: int = 5, topic="topic_id", text="text", min_df: int = 2, digits: int = 9) -> DataFrame:
    """(bin, topic, term, weight, rank): the k words that tell a topic in a bin from all other topics and bins."""
    d = with_time_bins(docs, ts, bins).withColumn("_class", F.struct("bin", topic))
    w = class_tfidf(d, "_class", text, min_df=min_df).withColumn("weight", F.round("weight", digits))
    return top_per(w, "_class", "weight", k).select("_class.*", "term", "weight", "rank")


def representative(docs: DataFrame, n: int = 10, topic="topic_id", prob="topic_prob", id="id") -> DataFrame:
    return top_per(docs, topic, prob, n, tie=id)
