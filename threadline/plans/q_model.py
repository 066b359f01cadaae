"""Queries over labels, vectors and clusters, topics, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PERIODS
from ..functions import features as X
from ..operators import clusters as C
from ..operators import density as D
from ..operators import sentiment as N
from ..operators import stats as S
from ..operators import terms as W
from ..operators import merging as M
from ..operators import topics as O
from ..operators import vectors as V
from ..operators.periods import periods_at
from ..sources.shared import folder
from ..streaming import streams as Z
from . import sqltext as Q
from .inputs import ACTIVITY, NOISY, PROFILES, VECTORS, activity, dated_vectors, letter_profiles, noisy_comments, table, texts
from .pipelines import sentiment_tables

RADII = [15.0, 20.0, 30.0, 45.0]
POSITIVE, NEGATIVE = ["the", "and", "la", "der"], ["of", "to", "que", "die"]


def labelled(spark, d):
    """Documents with a sentiment from their labels; confidence from the length."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return N.score_sentiment(t, label, F.col("n_chars") / (F.col("n_chars") + 1000.0))


def sentiment_scores(spark, d):
    return labelled(spark, d).select("doc_id", "sentiment_label", F.round("sentiment_score", 6).alias("score"), X.sentiment_bucket(F.col("sentiment_score")).alias("bucket"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith(("mean", "std")) or c.endswith("ratio")})


def sentiment_by_group(spark, d):
    return _rounded(N.aggregate(labelled(spark, d), "lang"))


def sentiment_by_group_period(spark, d):
    t = labelled(spark, d).withColumn("period", F.col("doc_id") % 12)
    return _rounded(N.aggregate(t, "lang", "period"))


def sentiment_summary(spark, d):
    return _rounded(N.aggregate(labelled(spark, d)))


def lexicon_sentiment(spark, d):
    label, conf = N.lexicon_score(F.col("text"), POSITIVE, NEGATIVE)
    t = N.score_sentiment(texts(spark, d), label, conf)
    return t.select("id", "sentiment_label", F.round("sentiment_score", 6).alias("score"))


def centroids(spark, d):
    c = V.centroids(dated_vectors(spark, d), "cluster_id")
    return c.select("cluster_id", "n", F.posexplode("centroid").alias("i", "x")).select("cluster_id", "n", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def vector_lookup(spark, d):
    """Vectors of asked-for ids, unknown ones as null."""
    from ..sources.archive import embeddings_of

    store = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return embeddings_of(store, ids).groupBy(F.col("embedding").isNull().alias("unknown")).agg(F.count("*").alias("n"))


def cluster_summary(spark, d):
    s = C.cluster_summary(dated_vectors(spark, d), sentiment="score")
    return s.withColumns({"communities": F.array_join(F.transform(F.map_entries("communities"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","), "mean_sentiment": F.round("mean_sentiment", 4), "std_sentiment": F.round("std_sentiment", 4)})


def cluster_totals(spark, d):
    v = dated_vectors(spark, d).withColumn("cluster_id", F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id")))
    return C.totals(v).withColumn("noise_pct", F.round("noise_pct", 4))


def temporal_clusters(spark, d):
    return C.temporal_clusters(dated_vectors(spark, d), F.col("period")).withColumn("share", F.round("share", 6))


def cluster_evolution(spark, d):
    e = C.evolution(dated_vectors(spark, d), threshold=0.0)
    return e.withColumn("similarity", F.round("similarity", 6))


def flow_edges(spark, d):
    return C.flow_edges(C.evolution(dated_vectors(spark, d), threshold=0.0)).withColumns({"similarity": F.round("similarity", 6), "source": F.col("source").cast("long"), "target": F.col("target").cast("long")})


def cluster_river(spark, d):
    """Long form of the river: the five largest clusters by year."""
    v = dated_vectors(spark, d)
    return v.filter(F.col("cluster_id").isin(S.top_values(v, "cluster_id", 5))).groupBy("period", "cluster_id").agg(F.count("*").alias("n"))


def cluster_heatmap(spark, d):
    return C.heatmap(dated_vectors(spark, d), "subreddit").withColumn("share", F.round("share", 6))


def representative_docs(spark, d):
    v = dated_vectors(spark, d).withColumn("prob", F.col("score"))
    return O.representative(v, 5, "cluster_id", "prob", "id").select("cluster_id", "id", "rank")


def cluster_labels(spark, d):
    s = C.cluster_summary(dated_vectors(spark, d))
    return s.select("cluster_id", X.cluster_label(F.col("cluster_id"), F.col("top_community"), F.col("n")).alias("label"))


def summary_requests(spark, d):
    v = dated_vectors(spark, d).withColumn("cluster_prob", F.col("score") / 1e6)
    t = texts(spark, d).select("id", "text")
    return C.summary_requests(C.sample_texts(v.join(t, "id"), n=6), C.cluster_summary(v.withColumn("mood", F.col("score") / 1e6 - 0.1), sentiment="mood")).select("cluster_id", "n", "n_samples", "top_community", F.md5("request").alias("request_md5"))


def density_clusters(spark, d):
    """Clusters of the documents' letter profiles over a ladder of radii, by excess of mass."""
    c = D.hierarchical_clusters(letter_profiles(spark, d), RADII, min_size=20, min_samples=5)
    return c.withColumn("cluster_prob", F.round("cluster_prob", 6))


def period_clusters(spark, d):
    """The same in each period on its own, with halved limits; periods below twice the least size are noise."""
    c = D.hierarchical_clusters(letter_profiles(spark, d), RADII, min_size=10, min_samples=3, within=("period",), least_rows=20)
    return c.withColumn("cluster_prob", F.round("cluster_prob", 6))


def pca_2d(spark, d):
    v = V.reduce_dimensions(dated_vectors(spark, d), 2)
    return v.select("id", "cluster_id", F.round(F.abs(F.col("reduced")[0]), 4).alias("x"), F.round(F.abs(F.col("reduced")[1]), 4).alias("y"))


def topic_model(spark, d):
    docs, words = O.fit_topics(texts(spark, d).select("id", "text"), 0.2)
    return O.topic_info(docs, words)


def topic_clusters(spark, d):
    """Topics merged down to two, their words ranked again by likeness: documents a topic."""
    docs, words = O.fit_topics(texts(spark, d).select("id", "text"), 0.2, n_topics=2, rerank=True)
    return docs.groupBy("topic_id").agg(F.count("*").alias("n")).join(words.groupBy("topic_id").agg(F.count("*").alias("words")).hint("shuffle_hash"), "topic_id", "left")


def scorer_sentiment(spark, d):
    """A scorer of the user's on texts cut as a model's input."""
    def load():
        import pandas as pd

        return lambda b: pd.DataFrame({"label": b.str.len().mod(3).map({0: "LABEL_pos", 1: "negative", 2: "neutral"}), "confidence": b.str.len() / 1000.0})

    t = N.score_with(texts(spark, d), load)
    return t.select("id", F.col("sentiment_label").alias("label"), F.round("sentiment_score", 6).alias("score"))


def sentiment_run(spark, d):
    """Scored texts summed up overall, by community, by month, and by both, in one table."""
    label, conf = N.lexicon_score(F.col("text"), POSITIVE, NEGATIVE)
    t = N.score_sentiment(texts(spark, d).withColumn("year_month", F.concat(F.lit("2024-"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"))), label, conf)
    parts = sentiment_tables(t)
    keyed = [p.withColumns({c: F.lit(None).cast("string") for c in ("subreddit", "year_month") if c not in p.columns}).withColumn("level", F.lit(k)) for k, p in parts.items()]
    out = keyed[0]
    for p in keyed[1:]:
        out = out.unionByName(p)
    return out.select("level", "subreddit", "year_month", "total", F.round("mean_sentiment", 6).alias("mean_sentiment"), "positive_count", "negative_count")


def embedder_hook(spark, d):
    def load():
        return lambda b: [[float(len(x)), float(x.count(" "))] for x in b]

    e = V.embed_with(texts(spark, d), load)
    return e.select("id", F.col("embedding")[0].cast("long").alias("chars"), F.col("embedding")[1].cast("long").alias("blanks"))


def embedding_index(spark, d):
    """Ids by place in an index, unknown places without one, and the members of a cluster."""
    from ..sources.archive import ids_at, members

    e = table(spark, d, "embeddings")
    index = e.select((F.col("vec_id") * 2).alias("embedding_idx"), F.col("vec_id").alias("id"))
    got = ids_at(index, e.select(F.col("vec_id").alias("embedding_idx")))
    mine = members(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id")), 3)
    return got.join(mine.withColumn("in_cluster", F.lit(True)).hint("shuffle_hash"), "id", "left").select("embedding_idx", "id", F.coalesce("in_cluster", F.lit(False)).alias("in_cluster"))


def topic_reduction(spark, d):
    """Sources as topics, merged down to eight by the likeness of their terms."""
    t = table(spark, d, "documents").select("text", F.crc32("source").alias("topic_id"))
    m = M.merged_topics(t.withColumn("was", F.col("topic_id")), 8)
    return m.groupBy(F.col("was").alias("topic_id"), F.col("topic_id").alias("into")).agg(F.count("*").alias("n"))


def topics_over_time(spark, d):
    return O.topics_over_time(dated_vectors(spark, d), "ts", 30, "cluster_id")


def words_over_time(spark, d):
    """The three words that tell a language in each quarter of the time."""
    t = table(spark, d, "documents").select("text", F.col("lang").alias("topic_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("ts"))
    return O.words_over_time(t, "ts", 4, 3)


def topics_by_group(spark, d):
    return O.topics_by_group(dated_vectors(spark, d), "subreddit", "cluster_id").withColumn("share", F.round("share", 6))


def topic_words(spark, d):
    """Labels and words of given classes (sources), as a topic table."""
    w = W.top_per(W.class_tfidf(texts(spark, d), "subreddit", min_df=2).withColumn("weight", F.round("weight", 9)), "subreddit", "weight", 4)
    return O.topic_labels(w, topic="subreddit")


def response_parsing(spark, d):
    """JSON out of answers that wrap it in prose; a fallback where there is none."""
    from ..functions.text import response_record

    t = table(spark, d, "conversations").withColumn("answer", F.when(F.col("turn") % 2 == 0, F.concat(F.lit('Sure: {"label": "t'), F.col("turn"), F.lit('", "summary": "s'), F.col("conv_id"), F.lit('"} ok'))).otherwise(F.col("text")))
    rec = response_record(F.col("answer"), "label string, summary string")
    return t.select("conv_id", "turn", rec["label"].alias("label"), F.md5(rec["summary"]).alias("summary_md5"))


def flashpoints(spark, d):
    """The configured periods in order of their start, with the number of events of the table inside."""
    p = spark.createDataFrame(PERIODS, "key string, name string, start string, end string, priority string")
    e = activity(spark, d).select("ts")
    n = e.select(F.explode(periods_at(F.col("ts"), [(k, s, t) for k, _, s, t, _ in PERIODS])).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return p.join(n.hint("shuffle_hash"), "key", "left").select("key", "priority", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _stream(spark, df, name, mode="append"):
    """Run a stream over what is there and read its sink."""
    base = folder(spark, name)
    Z.run_available(df, base + "/out", base + "/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(base + "/out")


def _source(spark, df, name):
    """A folder of Parquet files as a stream of the given table."""
    path = folder(spark, name)
    df.write.parquet(path)
    return Z.stream_table(spark, path)


def stream_window_counts(spark, d):
    """Hourly counts per community; a last row moves the watermark past the data, as later input would."""
    a = activity(spark, d).select("id", "ts", "subreddit")
    end = a.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("id"), (F.col("ts") + F.expr("interval 9 days")).alias("ts"), F.lit("end").alias("subreddit"))
    s = _source(spark, a.unionByName(end), "activity")
    return _stream(spark, Z.stream_window_counts(s, "ts", "subreddit"), "counts").filter("subreddit <> 'end'")


def stream_dedup(spark, d):
    a = activity(spark, d).select("id", "ts", "subreddit")
    s = _source(spark, a.unionByName(a), "twice")
    return _stream(spark, Z.dedup_stream(s, "id", "ts", "60 days"), "dedup").groupBy("subreddit").agg(F.count("*").alias("n"))


def stream_clean(spark, d):
    s = _source(spark, noisy_comments(spark, d), "comments")
    return _stream(spark, Z.stream_clean(s, "author", "body"), "clean").select("id", "body_clean")


def stream_alignment(spark, d):
    """Daily events joined with posts as two streams; every seventh event has no posts. Last rows move both watermarks past the data."""
    a = activity(spark, d).select("id", "ts", "subreddit")
    day = F.date_trunc("day", "ts")
    keyword = F.when(F.dayofmonth("event_ts") % 7 == 0, "nothing").otherwise("click")
    e = a.filter("subreddit = 'purchase'").select(day.alias("event_ts")).distinct().select(F.date_format("event_ts", "yyyy-MM-dd").alias("event_id"), "event_ts", keyword.alias("keyword"))
    over = F.expr("interval 30 days")
    posts = a.unionByName(a.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("id"), (F.col("ts") + over).alias("ts"), F.lit("end").alias("subreddit")))
    events = e.unionByName(e.agg(F.max("event_ts").alias("event_ts")).select(F.lit("end").alias("event_id"), (F.col("event_ts") + over).alias("event_ts"), F.lit("none").alias("keyword")))
    s = Z.stream_alignment(_source(spark, posts, "posts"), _source(spark, events, "events"), unmatched=True)
    return _stream(spark, s, "aligned").filter("event_id <> 'end'").groupBy("event_id", "keyword").agg(F.count("id").alias("n"))


def stream_query_hits(spark, d):
    n = noisy_comments(spark, d).select(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600).alias("ts"), "body")
    end = n.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 9 days")).alias("ts"), F.lit("https").alias("body"))
    s = _source(spark, n.unionByName(end), "hits")
    last = n.agg(F.date_trunc("day", F.max("ts"))).first()[0]
    return _stream(spark, Z.stream_query_hits(s, ["https", "the and"], "ts", "body"), "queryhits").filter(F.col("window_start") <= F.lit(last))


X_ = f"WITH {VECTORS} "
_LAB = "WITH l AS (SELECT d.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS lab, n_chars / (n_chars + 1000.0) AS conf FROM documents d JOIN labels USING (doc_id)), s AS (SELECT *, CASE lab WHEN 'positive' THEN conf WHEN 'negative' THEN -conf ELSE 0 END AS sc FROM l) "
_AGG = "round(avg(sc), 6) AS mean_sentiment, round(stddev_samp(sc), 6) AS std_sentiment, count(*) AS total, " + ", ".join(f"count(*) FILTER (lab = '{k}') AS {k}_count, round(count(*) FILTER (lab = '{k}') / count(*), 6) AS {k}_ratio" for k in ("positive", "negative", "neutral"))
_CENT = f"{X_}, e AS (SELECT period, cluster_id, i, avg(embedding[i]) AS x FROM (SELECT period, cluster_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM vectors) GROUP BY 1, 2, 3), c AS (SELECT period, cluster_id, list(x ORDER BY i) AS v FROM e GROUP BY 1, 2), n AS (SELECT period, cluster_id, count(*) AS n FROM vectors GROUP BY 1, 2), p AS (SELECT period, lead(period) OVER (ORDER BY period) AS nx FROM (SELECT DISTINCT period FROM vectors)), m AS (SELECT a.period AS from_period, b.period AS to_period, a.cluster_id AS from_cluster, b.cluster_id AS to_cluster, list_cosine_similarity(a.v, b.v) AS similarity FROM c a JOIN p ON a.period = p.period JOIN c b ON b.period = p.nx QUALIFY row_number() OVER (PARTITION BY a.period, a.cluster_id ORDER BY similarity DESC, b.cluster_id) = 1), evo AS (SELECT m.*, x.n AS from_count, y.n AS to_count FROM m JOIN n x ON x.period = from_period AND x.cluster_id = from_cluster JOIN n y ON y.period = to_period AND y.cluster_id = to_cluster WHERE similarity > 0)"
_LEX = f"WITH t AS (SELECT doc_id AS id, string_split({Q.normal('text')}, ' ') AS w FROM documents), h AS (SELECT id, len(list_filter(w, lambda x: x IN ('the', 'and', 'la', 'der'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'to', 'que', 'die'))) AS n FROM t)"
def _density(least, samples, within="", rows=0):
    """The tree of density clusters in SQL: components of each rung by reachability, then rung by rung clusters that go on, end and begin."""
    w, out = (f"AND x.{within} IS NOT DISTINCT FROM y.{within}", f"{within}, ") if within else ("", "")
    k, rate = len(RADII), [1.0 / r for r in RADII]
    few = f"JOIN (SELECT {within} AS g FROM profiles GROUP BY 1 HAVING count(*) >= {rows}) ON g IS NOT DISTINCT FROM {within}" if within else ""
    sql = [PROFILES, f"pts AS MATERIALIZED (SELECT profiles.* FROM profiles {few})"]
    sql.append(f"near AS MATERIALIZED (SELECT x.id AS a, y.id AS b, list_distance(x.embedding, y.embedding) AS d FROM pts x JOIN pts y ON true {w} WHERE list_distance(x.embedding, y.embedding) <= {RADII[-1]})")
    for r, radius in enumerate(RADII):
        sql.append(f"core{r} AS MATERIALIZED (SELECT a AS id FROM near WHERE d <= {radius} GROUP BY 1 HAVING count(*) > {samples})")
        sql.append(f"reach{r} AS (SELECT id AS a, id AS b FROM core{r} UNION SELECT r.a, n.b FROM reach{r} r JOIN near n ON n.a = r.b JOIN core{r} c ON c.id = n.b WHERE d <= {radius})")
        sql.append(f"lab{r} AS MATERIALIZED (SELECT a AS id, min(b) AS root FROM reach{r} GROUP BY 1)")
        sql.append(f"size{r} AS (SELECT root, count(*) AS size FROM lab{r} GROUP BY 1 HAVING count(*) >= {least})")
        name = f"{{'rung': {r}, 'root': root}}"
        if not r:
            sql.append(f"alive0 AS MATERIALIZED (SELECT root, size, {name} AS cluster, size * {rate[0]!r}::DOUBLE AS mass, NULL::DOUBLE AS parts FROM size0)")
            continue
        sql.append(f"moved{r} AS MATERIALIZED (SELECT cluster, mass, size, parts, l.root AS dest, mass - size * {rate[r]!r}::DOUBLE AS own, greatest(mass - size * {rate[r]!r}::DOUBLE, coalesce(parts, 0)) AS value FROM alive{r - 1} a JOIN lab{r} l ON l.id = a.root)")
        sql.append(f"met{r} AS (SELECT dest, count(*) AS k, sum(value) AS worth, any_value(cluster) AS one, any_value(mass) AS m, any_value(size) AS s, any_value(parts) AS p FROM moved{r} GROUP BY 1)")
        sql.append(f"alive{r} AS MATERIALIZED (SELECT root, size, CASE WHEN k = 1 THEN one ELSE {name} END AS cluster, CASE WHEN k = 1 THEN m + (size - s) * {rate[r]!r}::DOUBLE ELSE size * {rate[r]!r}::DOUBLE END AS mass, CASE WHEN k = 1 THEN p ELSE worth END AS parts FROM size{r} LEFT JOIN met{r} ON dest = root)")
    ends = [f"SELECT cluster, {{'rung': {r}, 'root': dest}} AS parent, own, parts FROM moved{r} JOIN met{r} USING (dest) WHERE k > 1" for r in range(1, k)]
    ends.append(f"SELECT cluster, NULL AS parent, mass - size * {rate[-1]!r}::DOUBLE AS own, parts FROM alive{k - 1}")
    sql.append(f"tree AS MATERIALIZED (SELECT cluster, parent, own >= coalesce(parts, 0) AS best FROM ({' UNION ALL '.join(ends)}))")
    sql.append("chosen AS (SELECT cluster, CASE WHEN best THEN cluster END AS label FROM tree WHERE parent IS NULL UNION ALL SELECT t.cluster, coalesce(c.label, CASE WHEN t.best THEN t.cluster END) FROM tree t JOIN chosen c ON t.parent = c.cluster)")
    sql.append(f"places AS (SELECT id, min(rung) AS rung, arg_min(cluster, rung) AS cluster FROM ({' UNION ALL '.join(f'SELECT id, {r} AS rung, cluster FROM lab{r} JOIN alive{r} USING (root)' for r in range(k))}) GROUP BY 1)")
    sql.append(f"held AS (SELECT id, label, least(1.0, [{', '.join(f'{x!r}::DOUBLE' for x in rate)}][rung + 1] / [{', '.join(f'{x!r}::DOUBLE' for x in rate)}][label.rung + 1]) AS prob FROM places JOIN chosen USING (cluster) WHERE label IS NOT NULL)")
    sql.append("named AS (SELECT label, min(id) AS name FROM held GROUP BY 1)")
    also = f"CAST(p.{within} AS INT) AS {within}, " if within else ""
    return f"WITH RECURSIVE {', '.join(sql)} SELECT p.id, {also}coalesce(name, -1) AS cluster_id, round(coalesce(prob, 0), 6) AS cluster_prob, name IS NULL AS is_noise FROM profiles p LEFT JOIN held USING (id) LEFT JOIN named USING (label)"


_TERMS = f"t AS (SELECT doc_id, source, {Q.terms('text')} AS w FROM documents)"
_VALID = " AND ".join(f"NOT {c}" for c in Q.reasons("author", "body").values())

QUERIES = {
    "sentiment_scores": (sentiment_scores, _LAB + "SELECT doc_id, lab AS sentiment_label, round(sc, 6) AS score, CASE WHEN sc > 0.2 THEN 'positive' WHEN sc < -0.2 THEN 'negative' ELSE 'neutral' END AS bucket FROM s"),
    "sentiment_by_group": (sentiment_by_group, _LAB + f"SELECT lang, {_AGG} FROM s GROUP BY 1"),
    "sentiment_by_group_period": (sentiment_by_group_period, _LAB + f"SELECT lang, doc_id % 12 AS period, {_AGG} FROM s GROUP BY 1, 2"),
    "sentiment_summary": (sentiment_summary, _LAB + f"SELECT {_AGG} FROM s"),
    "lexicon_sentiment": (lexicon_sentiment, f"{_LEX} SELECT id, CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS sentiment_label, round(coalesce((p - n) / nullif(p + n, 0), 0), 6) AS score FROM h"),
    "centroids": (centroids, f"{X_}, e AS (SELECT cluster_id, i - 1 AS i, avg(embedding[i]) AS x, count(*) AS n FROM (SELECT cluster_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM vectors) GROUP BY 1, 2) SELECT cluster_id, n, i, round(x, 6) AS x FROM e"),
    "vector_lookup": (vector_lookup, "SELECT vec_id IS NULL AS unknown, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1"),
    "cluster_summary": (cluster_summary, f"{X_}, k AS (SELECT cluster_id, subreddit, count(*) AS k FROM vectors GROUP BY 1, 2), m AS (SELECT cluster_id, string_agg(subreddit || ':' || k, ',' ORDER BY subreddit) AS communities, arg_min(subreddit, (-k, subreddit)) AS top_community FROM k GROUP BY 1) SELECT cluster_id, count(*) AS n, any_value(top_community) AS top_community, min(ts) AS first_at, max(ts) AS last_at, round(avg(score), 4) AS mean_sentiment, round(stddev_samp(score), 4) AS std_sentiment, any_value(communities) AS communities FROM vectors JOIN m USING (cluster_id) GROUP BY 1"),
    "cluster_totals": (cluster_totals, f"{X_} SELECT count(DISTINCT cluster_id) FILTER (cluster_id <> 0) AS clusters, count(*) FILTER (cluster_id = 0) AS noise, round(100.0 * count(*) FILTER (cluster_id = 0) / count(*), 4) AS noise_pct FROM vectors"),
    "temporal_clusters": (temporal_clusters, f"{X_}, g AS (SELECT CAST(period AS INT) AS period, cluster_id, count(*) AS n FROM vectors GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY period), 6) AS share FROM g"),
    "cluster_evolution": (cluster_evolution, f"{_CENT} SELECT CAST(from_period AS INT) AS from_period, CAST(to_period AS INT) AS to_period, from_cluster, to_cluster, round(similarity, 6) AS similarity, from_count, to_count FROM evo"),
    "flow_edges": (flow_edges, f"{_CENT}, nodes AS (SELECT p, c, row_number() OVER (ORDER BY p, c) - 1 AS id FROM (SELECT from_period AS p, from_cluster AS c FROM evo UNION SELECT to_period, to_cluster FROM evo)) SELECT a.id AS source, b.id AS target, from_count * 10 AS value, round(similarity, 6) AS similarity FROM evo JOIN nodes a ON a.p = from_period AND a.c = from_cluster JOIN nodes b ON b.p = to_period AND b.c = to_cluster"),
    "cluster_river": (cluster_river, f"{X_} SELECT CAST(period AS INT) AS period, cluster_id, count(*) AS n FROM vectors WHERE cluster_id IN (SELECT cluster_id FROM vectors GROUP BY 1 ORDER BY count(*) DESC, cluster_id LIMIT 5) GROUP BY 1, 2"),
    "cluster_heatmap": (cluster_heatmap, f"{X_} SELECT subreddit, cluster_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY subreddit), 6) AS share FROM vectors GROUP BY 1, 2"),
    "representative_docs": (representative_docs, f"{X_} SELECT cluster_id, id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id) AS INT) AS rank FROM vectors QUALIFY rank <= 5"),
    "cluster_labels": (cluster_labels, f"{X_}, k AS (SELECT cluster_id, subreddit, count(*) AS k FROM vectors GROUP BY 1, 2) SELECT cluster_id, concat('C', cluster_id, ' (r/', arg_min(subreddit, (-k, subreddit)), ', n=', CAST(sum(k) AS BIGINT), ')') AS label FROM k GROUP BY 1"),
    "summary_requests": (summary_requests, f"""{X_}, v AS (SELECT vectors.id, cluster_id, score / 1e6 AS prob, text FROM vectors JOIN documents ON doc_id = vectors.id), tp AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY prob DESC, id) AS rk FROM v QUALIFY rk <= 3), dr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('42:' || id), id) AS h FROM v QUALIFY h <= 6), rs AS (SELECT dr.*, row_number() OVER (PARTITION BY dr.cluster_id ORDER BY h) + 3 AS rk FROM dr ANTI JOIN tp ON tp.id = dr.id AND tp.cluster_id = dr.cluster_id QUALIFY rk <= 6), al AS (SELECT cluster_id, rk, text FROM tp UNION ALL SELECT cluster_id, rk, text FROM rs), pc AS (SELECT cluster_id, rk, '[' || rk || '] ' || CASE WHEN len(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS piece FROM al), g AS (SELECT cluster_id, string_agg(piece, chr(10) || chr(10) ORDER BY rk) AS samples, count(*) AS n_samples FROM pc GROUP BY 1), k AS (SELECT cluster_id, subreddit, count(*) AS k FROM vectors GROUP BY 1, 2), m AS (SELECT cluster_id, CAST(sum(k) AS BIGINT) AS n, arg_min(subreddit, (-k, subreddit)) AS top_community FROM k GROUP BY 1), z AS (SELECT cluster_id, strftime(min(ts), '%Y-%m-%d') AS lo, strftime(max(ts), '%Y-%m-%d') AS hi, avg(score / 1e6 - 0.1) AS mood FROM vectors GROUP BY 1) SELECT cluster_id, n, n_samples, top_community, md5('Cluster of ' || n || ' posts, mostly from r/' || top_community || ', from ' || lo || ' to ' || hi || ', ' || CASE WHEN mood > 0.2 THEN 'positive' WHEN mood < -0.2 THEN 'negative' ELSE 'neutral' END || ' on the whole.' || chr(10) || chr(10) || 'Samples:' || chr(10) || chr(10) || samples || chr(10) || chr(10) || 'Answer with JSON: label, summary.') AS request_md5 FROM g JOIN m USING (cluster_id) JOIN z USING (cluster_id)"""),
    "density_clusters": (density_clusters, _density(20, 5)),
    "period_clusters": (period_clusters, _density(10, 3, "period", 20)),
    "topic_clusters": (topic_clusters, None),
    "scorer_sentiment": (scorer_sentiment, f"WITH t AS (SELECT doc_id AS id, CASE WHEN {Q.strip('text')} <> '' THEN least(len(text), 512) END AS k FROM documents) SELECT id, CASE k % 3 WHEN 0 THEN 'LABEL_pos' WHEN 1 THEN 'negative' ELSE 'neutral' END AS label, round(CASE k % 3 WHEN 0 THEN k / 1000.0 WHEN 1 THEN -k / 1000.0 ELSE 0 END, 6) AS score FROM t"),
    "sentiment_run": (sentiment_run, f"{_LEX}, s AS (SELECT id, source AS subreddit, '2024-' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') AS year_month, coalesce((p - n) / nullif(p + n, 0), 0) AS sc FROM h JOIN documents ON doc_id = id) SELECT CASE WHEN grouping(subreddit) = 1 AND grouping(year_month) = 1 THEN 'summary' WHEN grouping(year_month) = 1 THEN 'by_community' WHEN grouping(subreddit) = 1 THEN 'by_month' ELSE 'by_both' END AS level, subreddit, year_month, count(*) AS total, round(avg(sc), 6) AS mean_sentiment, count(*) FILTER (sc > 0) AS positive_count, count(*) FILTER (sc < 0) AS negative_count FROM s GROUP BY GROUPING SETS ((), (subreddit), (year_month), (subreddit, year_month))"),
    "embedder_hook": (embedder_hook, "SELECT doc_id AS id, len(text) AS chars, len(text) - len(replace(text, ' ', '')) AS blanks FROM documents"),
    "embedding_index": (embedding_index, "SELECT e.vec_id AS embedding_idx, i.vec_id AS id, coalesce(i.label = 3, false) AS in_cluster FROM embeddings e LEFT JOIN embeddings i ON i.vec_id * 2 = e.vec_id"),
    "pca_2d": (pca_2d, None),
    "topic_model": (topic_model, None),
    "topic_reduction": (topic_reduction, None),
    "topics_over_time": (topics_over_time, f"{X_}, e AS (SELECT CAST(epoch_us(min(ts)) AS DOUBLE) AS lo, CAST(epoch_us(max(ts)) AS DOUBLE) AS hi FROM vectors) SELECT least(CAST(floor((epoch_us(ts) - lo) / ((hi - lo) / 30)) AS INT) + 1, 30) AS bin, cluster_id, count(*) AS n FROM vectors, e GROUP BY 1, 2"),
    "words_over_time": (words_over_time, f"WITH t AS (SELECT CAST((1704067200 + doc_id * 3600) * 1000000 AS DOUBLE) AS us, lang, {Q.terms('text')} AS w FROM documents), e AS (SELECT min(us) AS lo, max(us) AS hi FROM t), c AS (SELECT least(CAST(floor((us - lo) / ((hi - lo) / 4)) AS INT) + 1, 4) AS bin, lang, unnest(w) AS term FROM t, e), n AS (SELECT bin, lang, term, count(*) AS n FROM c GROUP BY ALL), z AS (SELECT bin, lang, sum(n) AS size FROM n GROUP BY ALL), m AS (SELECT avg(size) AS mean FROM z), f AS (SELECT term, sum(n) AS f FROM n GROUP BY 1 HAVING sum(n) >= 2), x AS (SELECT bin, lang AS topic_id, term, round(n / size * ln(1 + mean / f), 9) AS weight FROM n JOIN z USING (bin, lang) JOIN f USING (term), m) SELECT bin, topic_id, term, weight, CAST(row_number() OVER (PARTITION BY bin, topic_id ORDER BY weight DESC, term) AS INT) AS rank FROM x QUALIFY rank <= 3"),
    "topics_by_group": (topics_by_group, f"{X_} SELECT subreddit, cluster_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY subreddit), 6) AS share FROM vectors GROUP BY 1, 2"),
    "topic_words": (topic_words, f"WITH {_TERMS}, c AS (SELECT source, unnest(w) AS term FROM t), n AS (SELECT source, term, count(*) AS n FROM c GROUP BY 1, 2), z AS (SELECT source, sum(n) AS size FROM n GROUP BY 1), m AS (SELECT avg(size) AS mean FROM z), f AS (SELECT term, sum(n) AS f FROM n GROUP BY 1 HAVING sum(n) >= 2), x AS (SELECT source, term, round(n / size * ln(1 + mean / f), 9) AS weight FROM n JOIN z USING (source) JOIN f USING (term), m), r AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM x QUALIFY rank <= 4) SELECT source AS subreddit, source || '_' || string_agg(term, '_' ORDER BY rank) AS topic_label FROM r GROUP BY 1"),
    "response_parsing": (response_parsing, "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE 'Unknown' END AS label, md5(CASE WHEN turn % 2 = 0 THEN 's' || conv_id ELSE substr(text, 1, 500) END) AS summary_md5 FROM conversations"),
    "flashpoints": (flashpoints, f"WITH {ACTIVITY}, p(key, s, e, priority) AS (VALUES " + ", ".join(f"('{k}', TIMESTAMP '{s.replace('T', ' ')}', TIMESTAMP '{e.replace('T', ' ')}', '{pr}')" for k, _, s, e, pr in PERIODS) + ") SELECT key, priority, count(ts) AS n FROM p LEFT JOIN activity ON ts BETWEEN s AND e GROUP BY 1, 2"),
    "stream_window_counts": (stream_window_counts, f"WITH {ACTIVITY} SELECT date_trunc('hour', ts) AS window_start, subreddit, count(*) AS n FROM activity GROUP BY 1, 2"),
    "stream_alignment": (stream_alignment, f"WITH {ACTIVITY}, ev AS (SELECT DISTINCT date_trunc('day', ts) AS event_ts FROM activity WHERE subreddit = 'purchase'), e AS (SELECT strftime(event_ts, '%Y-%m-%d') AS event_id, event_ts, CASE WHEN day(event_ts) % 7 = 0 THEN 'nothing' ELSE 'click' END AS keyword FROM ev) SELECT event_id, keyword, count(id) AS n FROM e LEFT JOIN activity a ON a.subreddit = keyword AND ts >= event_ts AND ts <= event_ts + INTERVAL 7 DAY GROUP BY 1, 2"),
    "stream_dedup": (stream_dedup, f"WITH {ACTIVITY} SELECT subreddit, count(*) AS n FROM activity GROUP BY 1"),
    "stream_clean": (stream_clean, f"WITH {NOISY}, c AS (SELECT id, {Q.clean('body')} AS body_clean FROM noisy WHERE {_VALID}) SELECT * FROM c WHERE {Q.words('body_clean')} >= 5"),
    "stream_query_hits": (stream_query_hits, f"WITH {NOISY}, h AS (SELECT date_trunc('day', TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT))) AS window_start, unnest(list_filter([CASE WHEN contains(lower(body), 'https') THEN 'https' END, CASE WHEN contains(lower(body), 'the') AND contains(lower(body), 'and') THEN 'the and' END], lambda x: x IS NOT NULL)) AS query FROM noisy) SELECT window_start, query, count(*) AS n FROM h GROUP BY 1, 2"),
}
