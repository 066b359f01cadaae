"""Topics merged into fewer by the likeness of their terms, in Spark rounds.

The likeness of two topics is the cosine of their term weights, and of merged
ones the mean over their pairs of topics, weighted by sizes (average linkage).
That mean is the product of the merged topics' mean vectors, so that no table of
pairs has to be kept: a round joins the vectors on their terms, and every two
topics that are each other's most alike merge. Average linkage never makes a
merge more alike than the ones before it, so the merges of all rounds, sorted by
likeness, are those of the one-by-one chain, and its first ones are taken.

A topic stands by its `terms` weightiest terms. Rounds write their tables; the
driver sees counts and two likenesses a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, small, written
from .clusters import components
from .terms import class_tfidf, top_per

DIGITS = 12  # sums in another order are the same likeness


def unit_vectors(weights: DataFrame, sizes: DataFrame, topic: str, terms: int) -> DataFrame:
    """(t, term, x): weights of the weightiest terms, scaled to length `size`."""
    top = top_per(weights, topic, "weight", terms)
    norm = top.groupBy(topic).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).filter("norm > 0")
    scale = norm.join(sizes.hint("shuffle_hash"), topic).select(topic, (F.col("size") / F.col("norm")).alias("scale"))
    return top.join(small(scale), topic).select(F.col(topic).alias("t"), "term", (F.col("weight") * F.col("scale")).alias("x"))


def likeness(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, s) for a < b: pairs of live topics that share a term."""
    y = vectors.join(small(sizes), "t").select("t", "term", (F.col("x") / F.col("size")).alias("y"))
    a, b = y.select(F.col("t").alias("a"), "term", F.col("y").alias("ya")), y.select(F.col("t").alias("b"), "term", F.col("y").alias("yb"))
    pairs = a.join(b.hint("shuffle_hash"), "term").filter("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("ya") * F.col("yb")), DIGITS).alias("s"))
    return pairs.filter("s > 0")


def mutual(pairs: DataFrame) -> DataFrame:
    """The pairs whose topics are each other's most alike; ties go to the smaller ids."""
    p = F.struct("s", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    best = pairs.select(F.explode(F.array("a", "b")).alias("t"), p.alias("p")).groupBy("t").agg(F.max("p").alias("p"))
    return best.groupBy("p").agg(F.count("*").alias("n")).filter("n = 2").select((-F.col("p.a")).alias("a"), (-F.col("p.b")).alias("b"), F.col("p.s").alias("s"))


def reduced(weights: DataFrame, sizes: DataFrame, n: int, topic: str = "topic_id", terms: int = 500) -> DataFrame:
    """(topic, into): every topic of sizes (topic, size) with the one of at most n that it goes into, named for the largest in it (ties: the smallest id).

    Topics are numbers. When nothing is alike any more, the smallest join the
    largest. With at most n topics, or none, all stay what they are.
    """
    z = written(sizes.select(F.col(topic).alias("t"), F.col("size").cast("long").alias("size")), "sizes")
    total = z.count()
    most = total - n
    if most <= 0:
        return z.select(F.col("t").alias(topic), F.col("t").alias("into"))
    v = written(unit_vectors(weights, sizes, topic, terms), "vectors")
    live, merges, found = z, None, 0
    while True:
        pairs = written(likeness(v, live), "pairs")
        best = pairs.agg(F.max("s")).first()[0]
        if best is None:
            break
        if found >= most:
            last = merges.orderBy(F.desc("s")).limit(most).agg(F.min("s")).first()[0]
            if last >= best:
                break
        now = written(mutual(pairs), "merges")
        discard(pairs)
        found += now.count()
        step = small(now.select(F.col("b").alias("t"), F.col("a").alias("into")))
        into = F.coalesce("into", "t").alias("t")
        v2 = written(v.join(step, "t", "left").groupBy(into, "term").agg(F.sum("x").alias("x")), "vectors")
        live2 = written(live.join(step, "t", "left").groupBy(into).agg(F.sum("size").alias("size")), "sizes")
        discard(v, *([live] if live is not z else []))
        v, live = v2, live2
        merges = now if merges is None else merges.unionAll(now)
    edges = z.select(F.col("t").alias("a"), F.col("t").alias("b"))
    if merges is not None:
        edges = edges.unionAll(merges.orderBy(F.desc("s"), "a", "b").limit(most).select("a", "b"))
    if found < most:
        order = (F.col("size"), -F.col("t"))
        largest = live.agg(F.max_by("t", F.struct(*order)).alias("a"))
        rest = live.orderBy(*order).limit(most - found).select(F.col("t").alias("b"))
        edges = edges.unionAll(rest.crossJoin(F.broadcast(largest)).select("a", "b"))  # one row
    roots = components(written(edges, "edges"))
    member = z.join(small(roots), F.col("t") == F.col("id")).select("t", "size", "root")
    name = member.groupBy("root").agg(F.max_by("t", F.struct("size", -F.col("t"))).alias("into"))
    return written(member.join(small(name), "root").select(F.col("t").alias(topic), "into"), "reduced")


def merged_topics(docs: DataFrame, n: int, topic: str = "topic_id", text: str = "text", terms: int = 500) -> DataFrame:
    """Documents with their topics merged down to n; outliers (-1) and rows without a topic stay so."""
    d = docs.filter(F.col(topic) != -1)
    sizes = written(d.groupBy(topic).agg(F.count("*").alias("size")), "sizes")
    of = reduced(class_tfidf(d, topic, text, min_df=2), sizes, n, topic, terms)
    kind = docs.schema[topic].dataType
    of = of.withColumnRenamed("into", "_into")
    return docs.join(small(of), topic, "left").withColumn(topic, F.coalesce("_into", topic).cast(kind)).select(*docs.columns)
