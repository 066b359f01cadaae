"""Term statistics: tokens are exploded once and counted by shuffle, never gathered into one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import both_in, mentions
from ..functions.text import is_term, ngrams, terms, tokens
from ..sources.shared import small, written


def words_of(df: DataFrame, text="text", stop: list[str] | None = None) -> Column:
    """The terms of a column of texts; a column of arrays holds them already."""
    return F.col(text) if isinstance(df.schema[text].dataType, T.ArrayType) else terms(F.col(text), stop)


def term_rows(df: DataFrame, text="text", n: int = 1, stop: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each n-gram of each document, within the document."""
    return df.select(*keep, F.explode(ngrams(words_of(df, text, stop), n)).alias("term"))


#: Words of which a search for frequent n-grams starts.
FIRST_WORDS = 1000


def gram_rows(df: DataFrame, n: int, keep: tuple[str, ...] = (), words="words") -> DataFrame:
    """A row (keep, w0, w1, ...) for each n-gram of a column of terms, its words apart."""
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return df.select(*keep, F.inline(F.arrays_zip(*[F.slice(words, i + 1, size) for i in range(n)])).alias(*[f"w{i}" for i in range(n)]))


def grams_among(df: DataFrame, good: DataFrame, n: int, keep: tuple[str, ...] = (), words="words") -> DataFrame:
    """(keep, term, n): the n-grams whose words are all among good (keep, term); a null in keep is nowhere."""
    g, side, names = gram_rows(df, n, keep, words), small(good), [f"w{i}" for i in range(n)]
    for c in names:
        g = g.join(side.select(*keep, F.col("term").alias(c)), [*keep, c], "left_semi")
    return g.groupBy(*keep, *names).agg(F.count("*").alias("n")).select(*keep, F.concat_ws(" ", *names).alias("term"), "n")


def top_terms(df: DataFrame, n: int, k: int, text="text", stop: list[str] | None = None) -> DataFrame:
    """The k most frequent n-grams.

    An n-gram is no more frequent than its words. So the n-grams of the most
    frequent words are counted first, and if the k-th of them is rarer than some
    word left out, those of all words that are as frequent as it.
    """
    if n == 1:
        return term_counts(df, text, 1, stop).orderBy(F.desc("n"), "term").limit(k)
    t = written(df.select(words_of(df, text, stop).alias("words")), "terms")
    one = written(term_counts(t, "words"), "words")
    first = one.select("n").orderBy(F.desc("n")).limit(FIRST_WORDS + k).agg(F.min("n"), F.count("*")).first()
    least = first[0] if first[1] == FIRST_WORDS + k else 1
    while True:
        found = written(grams_among(t, one.filter(F.col("n") >= least).select("term"), n).orderBy(F.desc("n"), "term").limit(k), "grams")
        last = found.agg(F.min("n"), F.count("*")).first()
        need = last[0] if last[1] == k else 1
        if need >= least:
            return found.orderBy(F.desc("n"), "term")
        least = need


def term_counts(df: DataFrame, text="text", n: int = 1, stop: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, term, n). Single words are counted first and tested after, each once."""
    if n > 1 or isinstance(df.schema[text].dataType, T.ArrayType):
        return term_rows(df, text, n, stop, keep).groupBy(*keep, "term").agg(F.count("*").alias("n"))
    words = df.select(*keep, F.explode(tokens(F.col(text))).alias("term")).groupBy(*keep, "term").agg(F.count("*").alias("n"))
    return words.filter(is_term(F.col("term"), stop))


def drop_pairs(bigrams: DataFrame, names: list[str]) -> DataFrame:
    """Bigrams but those whose two words are both in the list."""
    w = F.split("term", " ")
    return bigrams.filter(~both_in(w[0], w[1], names))


def lexical_stats(df: DataFrame, text="text", stop: list[str] | None = None) -> DataFrame:
    """Tokens, tokens kept, vocabulary size and its share of the tokens, in percent."""
    words = df.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter("term <> ''")
    kept = is_term(F.col("term"), stop)
    sizes = words.agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept_tokens"), F.count_if(kept).alias("vocabulary"))
    return sizes.withColumn("diversity_pct", 100.0 * F.try_divide(F.col("vocabulary").cast("double"), F.col("kept_tokens")))


def keyword_coverage(df: DataFrame, groups: dict[str, list[str]], text="text") -> DataFrame:
    """(topic, n): rows that mention some of the group's terms; one scan for all groups."""
    names = list(groups)
    one = df.agg(*[F.count_if(mentions(F.col(text), groups[g])).alias(f"g{i}") for i, g in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(g).alias("topic"), F.col(f"g{i}").alias("n")) for i, g in enumerate(names)])))


def topic_trend(df: DataFrame, groups: dict[str, list[str]], by: Column, text="text") -> DataFrame:
    """The same per period: (period, topic, n)."""
    names = list(groups)
    one = df.groupBy(by.alias("period")).agg(*[F.count_if(mentions(F.col(text), groups[g])).alias(f"g{i}") for i, g in enumerate(names)])
    return one.select("period", F.inline(F.array(*[F.struct(F.lit(g).alias("topic"), F.col(f"g{i}").alias("n")) for i, g in enumerate(names)])))


def panel_terms(df: DataFrame, panel: str, k: int, text="text", stop: list[str] | None = None, fold_plurals: bool = True, min_rows: int = 0) -> DataFrame:
    """(panel, term, n): the k most frequent words of each panel; a word's plural in s counts with it where both occur."""
    big = df if not min_rows else df.join(df.groupBy(panel).count().filter(F.col("count") > min_rows).select(panel), panel, "left_semi")
    c = term_counts(big, text, 1, stop, (panel,))
    if fold_plurals:
        base = c.select(F.col(panel).alias("_p"), F.concat("term", F.lit("s")).alias("_plural"), F.col("term").alias("_one"))
        c = c.join(base.hint("shuffle_hash"), (F.col(panel) == F.col("_p")) & (F.col("term") == F.col("_plural")), "left")
        c = c.groupBy(panel, F.coalesce("_one", "term").alias("term")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(panel).orderBy(F.desc("n"), "term")
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def compare_vocabulary(df: DataFrame, panel: str, left, right, k: int = 20, most: int = 15, text="text", stop: list[str] | None = None) -> DataFrame:
    """(term, left, right): full outer join of two panels' top k words, the most frequent in sum first."""
    t = panel_terms(df.filter(F.col(panel).isin(left, right)), panel, k, text, stop, fold_plurals=False)
    wide = t.groupBy("term").pivot(panel, [left, right]).agg(F.sum("n")).na.fill(0)
    wide = wide.withColumnsRenamed({str(left): "left_n", str(right): "right_n"})
    return wide.orderBy(F.desc(F.col("left_n") + F.col("right_n")), "term").limit(most)


def class_tfidf(df: DataFrame, cls: str, text="text", stop: list[str] | None = None, min_df: int = 1, grams: tuple[int, ...] = (1,)) -> DataFrame:
    """(class, term, weight): frequency within the class times ln(1 + average class size / frequency overall); over words, or also longer n-grams."""
    tf = term_counts(df, text, grams[0], stop, (cls,))
    for n in grams[1:]:
        tf = tf.unionByName(term_counts(df, text, n, stop, (cls,)))
    tf = written(tf, "tf")  # counted once, read by all that follows
    size = tf.groupBy(cls).agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    total = tf.groupBy("term").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_df)
    j = tf.join(total.hint("shuffle_hash"), "term").join(small(size), cls).crossJoin(F.broadcast(mean))  # a row a class, one row
    return j.select(cls, "term", (F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("f"))).alias("weight"))


def top_per(df: DataFrame, group: str, by: str, k: int, tie: str = "term") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_class_terms(df: DataFrame, cls: str, k: int, words="words", min_df: int = 1, grams: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(class, term, weight, rank): the k weightiest of class_tfidf, from a column of terms; longer n-grams are counted only where they can be among them.

    With n occurrences in its class a term weighs n / size * ln(1 + mean / n) at
    most, which rises with n, and an n-gram is no more frequent than its words.
    So the k-th weight among single words says which words an n-gram must have.
    Rows without a class are left out.
    """
    if grams[0] != 1 or len(grams) < 2:
        return top_per(class_tfidf(df, cls, words, min_df=min_df, grams=grams), cls, "weight", k)
    t = df.filter(F.col(cls).isNotNull()).select(cls, F.col(words).alias("words"))
    held = F.lit(0)
    for n in grams:
        held = held + F.greatest(F.size("words") - (n - 1), F.lit(0))
    size = written(t.groupBy(cls).agg(F.sum(held).alias("size")).filter("size > 0"), "sizes")
    size = size.crossJoin(F.broadcast(size.agg(F.avg("size").alias("mean"))))  # one row
    one = written(term_counts(t, "words", keep=(cls,)), "tf")
    weigh = lambda f: F.col("n") / F.col("size") * F.log(1 + F.col("mean") / f)

    def weighed(tf: DataFrame, f: DataFrame) -> DataFrame:
        return tf.join(f.filter(F.col("f") >= min_df).hint("shuffle_hash"), "term").join(small(size), cls).select(cls, "term", weigh(F.col("f")).alias("weight"))

    best = written(top_per(weighed(one, one.groupBy("term").agg(F.sum("n").alias("f"))), cls, "weight", k), "words")
    bound = written(size.join(best.filter(F.col("rank") == k).select(cls, (F.col("weight") * (1 - 1e-9)).alias("least")).hint("shuffle_hash"), cls, "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "bounds")
    fit = lambda tf: tf.join(small(bound), cls).filter(weigh(F.col("n")) >= F.col("least"))
    good = written(fit(one).select(cls, "term"), "good")
    out = best.select(cls, "term", "weight")
    for n in grams[1:]:
        tf = written(fit(grams_among(t, good, n, (cls,))).select(cls, "term", "n"), "tf")
        names, parts = [f"w{i}" for i in range(n)], F.split("term", " ")
        asked = written(tf.select("term").distinct().select(*[parts[i].alias(c) for i, c in enumerate(names)]), "asked")
        f = gram_rows(t, n).join(small(asked), names, "left_semi").groupBy(*names).agg(F.count("*").alias("f"))  # over all classes
        out = out.unionByName(weighed(tf, f.select(F.concat_ws(" ", *names).alias("term"), "f")))
    return top_per(out, cls, "weight", k)


def cluster_keywords(df: DataFrame, cluster: str, doc: str, text="text", k: int = 10, vocabulary: int = 1000, stop: list[str] | None = None) -> DataFrame:
    """(cluster, term, weight, rank): mean TF-IDF over each cluster's documents, all clusters in one job.

    The cluster's most frequent terms (1- and 2-grams) are its vocabulary; idf is
    ln((1 + n) / (1 + df)) + 1 within the cluster, and document vectors have length one.
    A pair of words is no more frequent than either, so pairs are counted of those
    words only that are as frequent as the last one that the vocabulary could have.
    """
    t = written(df.filter(F.col(cluster).isNotNull()).select(cluster, doc, words_of(df, text, stop).alias("words")), "terms")
    one = written(term_counts(t, "words", keep=(cluster,)), "words")
    last = top_per(one, cluster, "n", vocabulary).filter(F.col("rank") == vocabulary).select(cluster, F.col("n").alias("least"))
    good = written(one.join(small(written(last, "least")), cluster, "left").filter(F.col("n") >= F.coalesce("least", F.lit(1))).select(cluster, "term", "n"), "good")
    both = good.unionByName(grams_among(t, good.select(cluster, "term"), 2, (cluster,)))
    of = written(top_per(both, cluster, "n", vocabulary).select(cluster, "term", F.split("term", " ").alias("w")), "vocabulary")
    tf = None
    for n in (1, 2):
        names = [f"w{i}" for i in range(n)]
        side = small(of.filter(F.size("w") == n).select(cluster, "term", *[F.col("w")[i].alias(c) for i, c in enumerate(names)]))
        rows = gram_rows(t, n, (cluster, doc)).join(side, [cluster, *names]).select(cluster, doc, "term")
        tf = rows if tf is None else tf.unionByName(rows)
    tf = written(tf.groupBy(cluster, doc, "term").agg(F.count("*").alias("tf")), "tf")
    stats = tf.groupBy(cluster, "term").agg(F.count("*").alias("df"))
    docs = written(df.groupBy(cluster).agg(F.countDistinct(doc).alias("docs")), "docs")
    v = tf.join(small(written(stats, "stats")), [cluster, "term"]).join(small(docs), cluster)
    v = v.withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = v.groupBy(cluster, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    m = v.join(norm.hint("shuffle_hash"), [cluster, doc]).groupBy(cluster, "term").agg((F.sum(F.col("w") / F.col("norm")) / F.first("docs")).alias("weight"))
    return top_per(m, cluster, "weight", k)
