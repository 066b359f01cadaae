"""Queries over texts: rewrites, predicates, cleaning, search, threads, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import predicates as P
from ..functions import text as T
from ..operators import clean as C
from ..operators import search as R
from ..operators import stats as S
from ..operators import terms as W
from ..operators.periods import hourly_windows, monthly_windows
from ..operators.threads import flatten_threads
from . import sqltext as Q
from .inputs import NOISY, noisy_comments, table, texts

TOPICS = {"first": ["tion", "ment"], "second": ["heit", "keit"], "third": ["the ", "and "]}
QUERIES_ = ["the and", "der die", "que la", "el la", "le la les"]


def strip_markdown(spark, d):
    return noisy_comments(spark, d).select("id", T.remove_markup(T.remove_markdown_links(T.remove_urls(F.col("body")))).alias("plain"))


def clean_text_rows(spark, d):
    c = T.clean_text(F.col("body"))
    return noisy_comments(spark, d).select("id", c.alias("clean"), T.word_count(c).cast("long").alias("words"))


def cut_after_edit(spark, d):
    return noisy_comments(spark, d).select("id", T.strip(T.remove_edit_markers(F.col("body"), cut=True)).alias("body"))


def accents_folded(spark, d):
    return texts(spark, d).select("id", F.md5(T.normalize_accents(F.col("text"))).alias("folded_md5"))


def text_length_features(spark, d):
    return X.text_features(texts(spark, d), "text", "text").select("id", F.col("text_length").cast("long").alias("text_length"), F.col("text_word_count").cast("long").alias("text_word_count"), T.preview(F.col("text"), 50).alias("preview"))


def predicate_flags(spark, d):
    a, b = F.col("author"), F.col("body")
    return noisy_comments(spark, d).select("id", *[c.alias(k) for k, c in P.comment_reasons(a, b).items()])


def valid_comments(spark, d):
    return C.clean_comments(noisy_comments(spark, d)).select("id", "body_clean")


def valid_submissions(spark, d):
    t = noisy_comments(spark, d).withColumns({"title": F.col("body"), "selftext": F.col("body")})
    return C.clean_submissions(t).select("id", "title_clean", F.md5("full_text").alias("full_md5"))


def filter_reason_counts(spark, d):
    return C.reason_counts(noisy_comments(spark, d))


def first_reason_counts(spark, d):
    return C.first_reason_counts(noisy_comments(spark, d))


def retention_report(spark, d):
    return C.retention(noisy_comments(spark, d), P.valid_comment(F.col("author"), F.col("body"))).withColumn("kept_pct", F.round("kept_pct", 4))


def page_urls(spark, d):
    """Markup and links out of raw pages: what a text cleaner leaves of them, as lengths."""
    return table(spark, d, "pages").select("page_id", F.length(T.normalize_whitespace(F.regexp_replace(T.remove_urls(F.col("html")), "<[^>]*>", " "))).cast("long").alias("n"))


def comment_links(spark, d):
    c = table(spark, d, "lineitem").select(F.concat(F.lit("t3_"), F.col("l_orderkey")).alias("link_id"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("t1_"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber") - 1)).otherwise(F.concat(F.lit("t3_"), F.col("l_orderkey"))).alias("parent_id"), "l_linenumber")
    return c.select(X.submission_of(F.col("link_id"), F.lit("")).alias("submission"), X.parent_comment(F.col("parent_id")).alias("parent")).groupBy(F.col("parent").isNull().alias("top_level")).agg(F.count("*").alias("n"), F.countDistinct("submission").alias("submissions"))


def multi_query_search(spark, d):
    return R.matched_queries(texts(spark, d), QUERIES_).select("id", F.array_join("_matched_queries", "|").alias("queries"))


def query_hits(spark, d):
    return R.query_hits(R.matched_queries(texts(spark, d), QUERIES_))


def community_search(spark, d):
    """Community search with a stated query and time range: the 15 newest."""
    return R.search(texts(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)), "the that", "src1", "2024-01-04", "2024-02-09 12:00:00", 15, ("id", "ts"))


def _tree(spark, d):
    return noisy_comments(spark, d).withColumn("parent_id", F.when(F.col("turn") > 0, F.col("id") - 1))


def thread_flatten(spark, d):
    t = flatten_threads(_tree(spark, d))
    return t.select("id", F.col("_depth").cast("long").alias("depth"), F.col("_is_top_level").alias("top_level"), F.col("_parent_comment_id").alias("parent"))


def thread_depth(spark, d):
    t = flatten_threads(_tree(spark, d))
    return t.groupBy("conv_id").agg(F.max("_depth").cast("long").alias("depth"), F.count("*").alias("n"))


def keyword_coverage(spark, d):
    return W.keyword_coverage(texts(spark, d), TOPICS)


def topic_category_trend(spark, d):
    return W.topic_trend(texts(spark, d), TOPICS, F.col("lang"))


def top_unigrams(spark, d):
    return W.top_terms(texts(spark, d), 1, 20)


def top_bigrams(spark, d):
    return W.top_terms(texts(spark, d), 2, 15)


def top_trigrams(spark, d):
    return W.top_terms(texts(spark, d), 3, 10)


def bigrams_without_pairs(spark, d):
    c = W.term_rows(texts(spark, d), "text", 2).groupBy("term").agg(F.count("*").alias("n"))
    return S.top(W.drop_pairs(c, ["the", "and", "that", "for", "with", "are"]), 20, "n", "term")


def lexical_diversity(spark, d):
    return W.lexical_stats(texts(spark, d)).withColumn("diversity_pct", F.round("diversity_pct", 4))


def wordcloud_terms(spark, d):
    return W.panel_terms(texts(spark, d), "lang", 100)


def vocabulary_compare(spark, d):
    return W.compare_vocabulary(texts(spark, d), "lang", "en", "de")


def ctfidf_words(spark, d):
    w = W.class_tfidf(texts(spark, d), "lang", min_df=2)
    return W.top_per(w.withColumn("weight", F.round("weight", 9)), "lang", "weight", 10)


def cluster_keywords_tfidf(spark, d):
    t = W.cluster_keywords(texts(spark, d), "subreddit", "id", k=1000).drop("rank").withColumn("weight", F.round("weight", 9))
    return W.top_per(t, "subreddit", "weight", 5)


def emoji_filter(spark, d):
    """Strict and wide emoji ranges, full accent folding: digests of each text."""
    t = F.col("text")
    return texts(spark, d).select("id", F.length(T.remove_emojis(F.concat(t, F.lit(" \U0001f600 \u2713 \u65e5")), True)).cast("long").alias("strict_chars"), F.length(T.remove_emojis(F.concat(t, F.lit(" \U0001f600 \u2713 \u65e5")))).cast("long").alias("wide_chars"))


def length_flags(spark, d):
    return texts(spark, d).select("id", P.is_too_long(F.col("text"), 10000).alias("too_long"), F.length(T.model_input(F.col("text"))).cast("long").alias("input_chars"))


def top_queries(spark, d):
    return S.top(query_hits(spark, d).filter("n > 0"), 10, "n", "query")


def _dated(spark, d):
    return texts(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600))


def scan_grid(spark, d):
    """Every scan of a collection, with the sources' documents that it finds."""
    w = monthly_windows(spark, "2024-01-01", "2024-03-31")
    grid = R.scan_grid(["SRC1", "src2", "src3"], w, QUERIES_)
    m = R.windowed_matches(_dated(spark, d), ["SRC1", "src2", "src3"], w, QUERIES_, "monthly", "historical")
    n = m.select(F.col("subreddit").alias("c"), F.to_date("_window_start").alias("s"), F.explode("_matched_queries").alias("q")).groupBy("c", "s", "q").agg(F.count("*").alias("n"))
    j = grid.join(n.hint("shuffle_hash"), (F.lower("community") == F.col("c")) & (F.col("window_start") == F.col("s")) & (F.col("query") == F.col("q")), "left")
    return j.select(F.lower("community").alias("community"), "window_start", "window_end", "query", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def collected_grid(spark, d):
    """Documents of two overlapping window lists once each, with the first window's tags and all queries."""
    w = monthly_windows(spark, "2024-01-01", "2024-03-31").unionByName(monthly_windows(spark, "2024-01-15", "2024-02-29"))
    c = R.collect_windows(_dated(spark, d), ["src1", "src2", "src3"], w, QUERIES_)
    return c.select("id", F.to_date("_window_start").alias("window_start"), F.col("_granularity").alias("granularity"), F.col("_collection_type").alias("kind"), F.array_join("_matched_queries", "|").alias("queries"))


def hourly_collection(spark, d):
    """Hourly windows of a crisis: documents once each."""
    w = hourly_windows(spark, "2024-01-03 00:00:00", "2024-01-09 12:00:00").withColumn("window_end", F.col("window_end") - F.expr("interval 1 microsecond"))
    c = R.collect_windows(_dated(spark, d), [f"src{i}" for i in range(20)], w, ["the and", "que"], "hourly", "crisis")
    return c.select("id", F.col("_window_start").alias("window_start"), F.array_join("_matched_queries", "|").alias("queries"))


def nested_threads(spark, d):
    """Conversations as nested reply trees in JSON, taken apart again."""
    from ..operators.threads import flatten_nested

    n = noisy_comments(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "author", "body")), False).alias("t"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    node = lambda acc, x: F.concat(F.lit('{"'), x["id"], F.lit('": {"body": '), quoted(x["body"]), F.lit(', "author": '), quoted(x["author"]), F.lit(', "parent_id": "'), F.when(x["turn"] == 0, "t3_s").otherwise(F.concat(F.lit("t1_"), x["id"] - 1)), F.lit('", "replies": '), acc, F.lit("}}"))
    trees = n.select(F.col("conv_id").alias("submission_id"), F.aggregate("t", F.lit("{}"), node).alias("tree"))
    t = flatten_nested(trees)
    return t.select(F.col("_submission_id").alias("conv_id"), F.col("_id").cast("long").alias("id"), F.md5("body").alias("body_md5"), F.col("_depth").cast("long").alias("depth"), F.col("_is_top_level").alias("top_level"), F.col("_parent_comment_id").cast("long").alias("parent"))


#: Comments of one of the deep trees.
TREE = 1500


def deep_threads(spark, d):
    """Events as trees of 1,500 comments, a thousand levels deep: every third one ends a branch, the others go on."""
    from ..operators.threads import flatten_nested

    i = F.pmod("event_id", F.lit(TREE))
    name = lambda x: F.concat(F.lit("e"), x)
    above = F.when(i == 0, "t3_post").otherwise(F.concat(F.lit("t1_"), name(F.col("event_id") - F.when(i % 3 == 0, 2).otherwise(1))))
    head = F.concat(F.lit('"'), name(F.col("event_id")), F.lit('": {"body": "'), F.col("event_type"), F.lit('", "extra": {"k": [1, "}"]}, "score": '), F.col("user_id"), F.lit(', "parent_id": "'), above, F.lit('", "replies": '))
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / TREE).alias("submission_id"), i.alias("i"), head.alias("head"))
    t = e.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("i", "head"))).alias("t"))
    last = F.col("t")[F.size("t") - 1]["i"]
    piece = lambda x: F.concat(x["head"], F.when(x["i"] % 3 == 2, F.concat(F.lit('""}'), F.when(x["i"] < last, ", ").otherwise(""))).otherwise("{"))
    opened = F.size(F.filter("t", lambda x: x["i"] % 3 != 2))
    tree = F.concat(F.lit("{"), F.array_join(F.transform("t", piece), ""), F.repeat(F.lit("}}"), opened), F.lit("}"))
    f = flatten_nested(t.select("submission_id", tree.alias("tree")))
    return f.select(F.substring("_id", 2, 20).cast("long").alias("event_id"), F.col("_submission_id").alias("tree"), "body", F.col("score").cast("long").alias("score"), F.col("_depth").cast("long").alias("depth"), F.col("_is_top_level").alias("top_level"), F.substring("_parent_comment_id", 2, 20).cast("long").alias("parent"))


def comment_fields(spark, d):
    """Allowed fields, blanked strings, plain types and provenance of rows that hold more than that."""
    n = noisy_comments(spark, d)
    wide = n.withColumns({"distinguished": F.when(F.col("turn") % 3 == 0, "None").when(F.col("turn") % 3 == 1, "mod"), "edited": F.when(F.col("turn") % 2 == 0, "false").otherwise(F.col("id").cast("string")), "awards": F.array(F.lit("a"), F.col("author"))})
    kept = X.only(wide, ["id", "body", "author", "distinguished", "edited", "link_id"]).drop("body")
    plain = X.plain_types(wide.select("id", "awards")).withColumnRenamed("id", "i")
    j = kept.withColumn("distinguished", X.blank(F.col("distinguished"))).withColumn("edited", X.edited_at(F.col("edited"))).join(plain.hint("shuffle_hash"), F.col("id") == F.col("i")).drop("i")
    return X.provenance(j, kind="comment", author_kind=F.upper("author")).withColumnsRenamed({"_kind": "kind", "_author_kind": "author_kind"})


def comments_with_submission(spark, d):
    from ..operators.threads import with_submission

    c = noisy_comments(spark, d).select("id", F.col("conv_id").alias("submission_id"))
    p = texts(spark, d).select("id", F.col("text").alias("title"), F.length("text").cast("long").alias("score"))
    return with_submission(c, p).select("id", "submission_id", F.md5("_submission_title").alias("title_md5"), F.col("_submission_score").alias("score"))


N = f"WITH {NOISY} "
_WITH_SIGNS = "(text || ' \U0001f600 \u2713 \u65e5')"
_QLIST = "[" + ", ".join(Q.q(s) for s in QUERIES_) + "]"
_R = Q.reasons("author", "body")
_VALID = " AND ".join(f"NOT {c}" for c in _R.values())
_TERMS = f"WITH t AS (SELECT doc_id, lang, source, {Q.terms('text')} AS w FROM documents)"
_HITS = "list_filter([" + ", ".join(f"CASE WHEN {' AND '.join(f'contains(lower(text), {Q.q(t)})' for t in s.split())} THEN {Q.q(s)} END" for s in QUERIES_) + "], lambda x: x IS NOT NULL)"
_DATED = f"t AS (SELECT doc_id AS id, source, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS ts, {_HITS} AS h FROM documents)"
_TREE = f"WITH RECURSIVE {NOISY}, c AS (SELECT id, conv_id, CASE WHEN turn > 0 THEN id - 1 END AS parent FROM noisy), f AS (SELECT id, conv_id, parent, CAST(0 AS BIGINT) AS depth FROM c WHERE parent IS NULL UNION ALL SELECT c.id, c.conv_id, c.parent, f.depth + 1 FROM c JOIN f ON c.parent = f.id)"
_ANY = lambda ws: "regexp_matches(lower(text), " + Q.q("|".join(ws)) + ")"
_TITLE = "body"
_BOTH = f"concat_ws(' ', coalesce({_TITLE}, ''), coalesce(body, ''))"


def _grams(n, k, tail=""):
    return f"{_TERMS}, g AS (SELECT unnest({Q.grams('w', n)}) AS term FROM t) SELECT term, count(*) AS n FROM g {tail} GROUP BY 1 ORDER BY n DESC, term LIMIT {k}"


QUERIES = {
    "strip_markdown": (strip_markdown, f"{N} SELECT id, {Q.markup(Q.links(Q.urls('body')))} AS plain FROM noisy"),
    "clean_text_rows": (clean_text_rows, f"{N}, c AS (SELECT id, {Q.clean('body')} AS clean FROM noisy) SELECT id, clean, {Q.words('clean')} AS words FROM c"),
    "cut_after_edit": (cut_after_edit, f"{N} SELECT id, {Q.strip(Q.sub('body', '(?s)' + chr(92) + 'b(Edit|EDIT|edit|Update|UPDATE)' + Q.SPACE + '*' + chr(92) + 'p{Nd}*' + Q.SPACE + '*:.*$'))} AS body FROM noisy"),
    "accents_folded": (accents_folded, "SELECT doc_id AS id, md5(strip_accents(text)) AS folded_md5 FROM documents"),
    "text_length_features": (text_length_features, f"SELECT doc_id AS id, len(text) AS text_length, {Q.words('text')} AS text_word_count, CASE WHEN len(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview FROM documents"),
    "predicate_flags": (predicate_flags, f"{N} SELECT id, " + ", ".join(f"{c} AS {k}" for k, c in _R.items()) + " FROM noisy"),
    "valid_comments": (valid_comments, f"{N}, c AS (SELECT id, {Q.clean('body')} AS body_clean FROM noisy WHERE {_VALID}) SELECT * FROM c WHERE {Q.words('body_clean')} >= 5"),
    "valid_submissions": (valid_submissions, f"{N}, v AS (SELECT id, {Q.blanks(Q.markup(Q.links(Q.urls(_TITLE))))} AS title_clean, {Q.clean('body')} AS s FROM noisy WHERE NOT {Q.deleted_author('author')} AND NOT {Q.bot('author')} AND NOT {Q.deleted(_TITLE)} AND NOT (body <> '' AND {Q.deleted('body')}) AND NOT {Q.short(_TITLE, 2)} AND NOT {Q.mostly_url(_BOTH)} AND NOT {Q.moderation(_BOTH)}) SELECT id, title_clean, md5(trim(concat_ws(' ', title_clean, s))) AS full_md5 FROM v"),
    "filter_reason_counts": (filter_reason_counts, f"{N} " + " UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) FILTER ({c}) AS n FROM noisy" for k, c in _R.items())),
    "first_reason_counts": (first_reason_counts, f"{N} SELECT CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _R.items()) + " ELSE 'kept' END AS reason, count(*) AS n FROM noisy GROUP BY 1"),
    "retention_report": (retention_report, f"{N} SELECT count(*) AS total, count(*) FILTER ({_VALID}) AS kept, round(100.0 * count(*) FILTER ({_VALID}) / count(*), 4) AS kept_pct FROM noisy"),
    "page_urls": (page_urls, f"SELECT page_id, len({Q.blanks(Q.sub(Q.urls('html'), '<[^>]*>', ' '))}) AS n FROM pages"),
    "comment_links": (comment_links, "SELECT l_linenumber = 1 AS top_level, count(*) AS n, count(DISTINCT l_orderkey) AS submissions FROM lineitem GROUP BY 1"),
    "multi_query_search": (multi_query_search, f"WITH m AS (SELECT doc_id AS id, {_HITS} AS h FROM documents) SELECT id, array_to_string(h, '|') AS queries FROM m WHERE len(h) > 0"),
    "query_hits": (query_hits, f"WITH m AS (SELECT unnest({_HITS}) AS query FROM documents) SELECT query, count(*) AS n FROM m GROUP BY 1"),
    "community_search": (community_search, "SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS ts FROM documents WHERE lower(source) = 'src1' AND contains(lower(text), 'the') AND contains(lower(text), 'that') AND ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-02-09 12:00:00' ORDER BY ts DESC LIMIT 15"),
    "thread_flatten": (thread_flatten, f"{_TREE} SELECT id, depth, depth = 0 AS top_level, parent FROM f"),
    "thread_depth": (thread_depth, f"{_TREE} SELECT conv_id, max(depth) AS depth, count(*) AS n FROM f GROUP BY 1"),
    "keyword_coverage": (keyword_coverage, " UNION ALL ".join(f"SELECT '{k}' AS topic, count(*) FILTER ({_ANY(v)}) AS n FROM documents" for k, v in TOPICS.items())),
    "topic_category_trend": (topic_category_trend, " UNION ALL ".join(f"SELECT lang AS period, '{k}' AS topic, count(*) FILTER ({_ANY(v)}) AS n FROM documents GROUP BY 1" for k, v in TOPICS.items())),
    "top_unigrams": (top_unigrams, _grams(1, 20)),
    "top_bigrams": (top_bigrams, _grams(2, 15)),
    "top_trigrams": (top_trigrams, _grams(3, 10)),
    "bigrams_without_pairs": (bigrams_without_pairs, _grams(2, 20, "WHERE NOT (split_part(term, ' ', 1) IN ('the', 'and', 'that', 'for', 'with', 'are') AND split_part(term, ' ', 2) IN ('the', 'and', 'that', 'for', 'with', 'are'))")),
    "lexical_diversity": (lexical_diversity, f"{_TERMS}, s AS (SELECT CAST(sum(len(list_filter(string_split({Q.normal('text')}, ' '), lambda x: x <> ''))) AS BIGINT) AS tokens FROM documents), v AS (SELECT unnest(w) AS term FROM t) SELECT tokens, (SELECT count(*) FROM v) AS kept_tokens, (SELECT count(DISTINCT term) FROM v) AS vocabulary, round(100.0 * (SELECT count(DISTINCT term) FROM v) / (SELECT count(*) FROM v), 4) AS diversity_pct FROM s"),
    "wordcloud_terms": (wordcloud_terms, f"{_TERMS}, c AS (SELECT lang, unnest(w) AS term FROM t), n AS (SELECT lang, term, count(*) AS n FROM c GROUP BY 1, 2), f AS (SELECT n.lang, coalesce(o.term, n.term) AS term, CAST(sum(n.n) AS BIGINT) AS n FROM n LEFT JOIN n o ON o.lang = n.lang AND n.term = o.term || 's' GROUP BY 1, 2) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 100"),
    "vocabulary_compare": (vocabulary_compare, f"{_TERMS}, c AS (SELECT lang, unnest(w) AS term FROM t WHERE lang IN ('en', 'de')), n AS (SELECT lang, term, count(*) AS n FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 20) SELECT term, CAST(coalesce(sum(n) FILTER (lang = 'en'), 0) AS BIGINT) AS left_n, CAST(coalesce(sum(n) FILTER (lang = 'de'), 0) AS BIGINT) AS right_n FROM n GROUP BY 1 ORDER BY left_n + right_n DESC, term LIMIT 15"),
    "ctfidf_words": (ctfidf_words, f"{_TERMS}, c AS (SELECT lang, unnest(w) AS term FROM t), n AS (SELECT lang, term, count(*) AS n FROM c GROUP BY 1, 2), z AS (SELECT lang, sum(n) AS size FROM n GROUP BY 1), m AS (SELECT avg(size) AS mean FROM z), f AS (SELECT term, sum(n) AS f FROM n GROUP BY 1 HAVING sum(n) >= 2), x AS (SELECT lang, term, round(n / size * ln(1 + mean / f), 9) AS weight FROM n JOIN z USING (lang) JOIN f USING (term), m) SELECT lang, term, weight, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INT) AS rank FROM x QUALIFY rank <= 10"),
    "cluster_keywords_tfidf": (cluster_keywords_tfidf, f"{_TERMS}, g AS (SELECT source AS subreddit, doc_id, unnest(list_concat(w, {Q.grams('w', 2)})) AS term FROM t), tf AS (SELECT subreddit, doc_id, term, count(*) AS tf FROM g GROUP BY ALL), st AS (SELECT subreddit, term, sum(tf) AS f, count(*) AS df FROM tf GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY f DESC, term) <= 1000), dc AS (SELECT source AS subreddit, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1), v AS (SELECT *, tf * (ln((1 + docs) / (1 + df)) + 1) AS wt FROM tf JOIN st USING (subreddit, term) JOIN dc USING (subreddit)), nm AS (SELECT subreddit, doc_id, sqrt(sum(wt * wt)) AS norm FROM v GROUP BY 1, 2), m AS (SELECT subreddit, term, sum(wt / norm) / any_value(docs) AS weight FROM v JOIN nm USING (subreddit, doc_id) GROUP BY 1, 2), r AS (SELECT subreddit, term, round(weight, 9) AS weight FROM m) SELECT subreddit, term, weight, CAST(row_number() OVER (PARTITION BY subreddit ORDER BY weight DESC, term) AS INT) AS rank FROM r QUALIFY rank <= 5"),
    "emoji_filter": (emoji_filter, f"SELECT doc_id AS id, len({Q.sub(_WITH_SIGNS, f'[{T.EMOJI}]+')}) AS strict_chars, len({Q.sub(_WITH_SIGNS, f'[{T.EMOJI}{T.EMOJI_WIDE}]+')}) AS wide_chars FROM documents"),
    "length_flags": (length_flags, f"SELECT doc_id AS id, len(text) > 10000 AS too_long, CASE WHEN {Q.strip('text')} <> '' THEN least(len(text), 512) END AS input_chars FROM documents"),
    "top_queries": (top_queries, f"WITH m AS (SELECT unnest({_HITS}) AS query FROM documents) SELECT query, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, query LIMIT 10"),
    "scan_grid": (scan_grid, f"WITH {_DATED}, w(window_start, window_end) AS (VALUES (DATE '2024-01-01', DATE '2024-01-31'), (DATE '2024-02-01', DATE '2024-02-29'), (DATE '2024-03-01', DATE '2024-03-31')), c(community) AS (VALUES ('src1'), ('src2'), ('src3')), q(query) AS (SELECT unnest({_QLIST})) SELECT community, window_start, window_end, query, count(t.id) AS n FROM c CROSS JOIN w CROSS JOIN q LEFT JOIN t ON t.source = community AND CAST(t.ts AS DATE) BETWEEN window_start AND window_end AND list_contains(t.h, query) GROUP BY ALL"),
    "collected_grid": (collected_grid, f"WITH {_DATED}, w(s, e) AS (VALUES (DATE '2024-01-01', DATE '2024-01-31'), (DATE '2024-02-01', DATE '2024-02-29'), (DATE '2024-03-01', DATE '2024-03-31'), (DATE '2024-01-15', DATE '2024-02-14'), (DATE '2024-02-15', DATE '2024-02-29')) SELECT id, min(s) AS window_start, 'monthly' AS granularity, 'historical' AS kind, array_to_string(list_sort(any_value(h)), '|') AS queries FROM t JOIN w ON CAST(ts AS DATE) BETWEEN s AND e WHERE source IN ('src1', 'src2', 'src3') AND len(h) > 0 GROUP BY id"),
    "hourly_collection": (hourly_collection, "WITH t AS (SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INT)) AS ts, list_filter([CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'and') THEN 'the and' END, CASE WHEN contains(lower(text), 'que') THEN 'que' END], lambda x: x IS NOT NULL) AS h FROM documents) SELECT id, date_trunc('hour', ts) AS window_start, array_to_string(list_sort(h), '|') AS queries FROM t WHERE len(h) > 0 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09 12:00:00'"),
    "deep_threads": (deep_threads, f"WITH e AS (SELECT *, event_id % {TREE} AS i FROM events) SELECT event_id, event_id // {TREE} AS tree, event_type AS body, user_id AS score, i - i // 3 AS depth, i = 0 AS top_level, CASE WHEN i > 0 THEN event_id - CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END END AS parent FROM e"),
    "nested_threads": (nested_threads, f"{N} SELECT conv_id, id, md5(body) AS body_md5, turn AS depth, turn = 0 AS top_level, CASE WHEN turn > 0 THEN id - 1 END AS parent FROM noisy"),
    "comment_fields": (comment_fields, f"{N} SELECT id, author, CASE WHEN turn % 3 = 1 THEN 'mod' ELSE '' END AS distinguished, CASE WHEN turn % 2 = 0 THEN 0.0 ELSE CAST(id AS DOUBLE) END AS edited, '[\"a\",\"' || author || '\"]' AS awards, 'comment' AS kind, upper(author) AS author_kind FROM noisy"),
    "comments_with_submission": (comments_with_submission, f"{N} SELECT n.id, conv_id AS submission_id, md5(text) AS title_md5, len(text) AS score FROM noisy n LEFT JOIN documents ON doc_id = conv_id"),
}
