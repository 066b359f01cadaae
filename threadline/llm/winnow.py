"""Benchmark decontamination by winnowing, in built-in functions only.

Both sides become words, five-word hashes, and winnowed fingerprints: of every
six consecutive hashes the smallest is kept (the leftmost of equal ones). Two
texts that share ten words in a row (6 + 5 - 1) share one of these
fingerprints, so every shared window of ten words is found. A fingerprint is
32 bits of hash over 32 bits of position in one long, so that a plain minimum
gives both. Each kept fingerprint carries the hashes of the ten-word windows
around it; where fingerprints meet, the item's windows that hold it are
compared with the document's, which extends the hit in both directions.

Items of fewer than ten words are one window of their own length. A bitmap of
MARKS bits for each such length says which words can begin one; the documents'
windows of these lengths are made, in one pass, only where one can begin, and
are joined with those items.

Scale: documents are read in narrow stages; a row leaves its stage only after
it has met a benchmark fingerprint. The benchmark side is broadcast if its
counted fingerprints are at most BROADCAST_ROWS, else the join shuffles both
sides. Equal windows of items are one window, and their items are attached
after the hits are counted, so a passage in many items or in a third of the
documents costs what its hits cost.

Defined results: null texts have no words; a document without words has zero
counts and the digest of an empty list; null item ids are not listed; rows
that repeat a document are judged alike and stay; further columns are kept by
`contamination`, where clashing names are overwritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1  # hashes a fingerprint is the smallest of
BROADCAST_ROWS = 500_000
MARKS = 4096
#: Characters that are not part of words once A-Z are lower-cased; the same with A-Z still there.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text) -> F.Column:
    """Words of a text; null gives none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))  # the same for ASCII, and cheaper
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def word_count(text) -> F.Column:
    """How many words a text has; split, as counting matches of a pattern costs ten times as much."""
    return F.size(F.array_remove(F.split(text, RAW_BREAK), "")).cast("long")


def upto(n) -> F.Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds h: hashes of words, g: of five words (5-grams), w: of ten."""
    at = lambda a, i: F.get(F.col(a), i)
    return (
        df.withColumn("h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
        .withColumn("g", F.transform(upto(F.size("h") - (GRAM - 1)), lambda i: F.xxhash64(*[at("h", i + k) for k in range(GRAM)])))
        .withColumn("w", F.transform(upto(F.size("h") - (WINDOW - 1)), lambda i: F.xxhash64(at("g", i), at("g", i + GRAM))))
    )


def fingerprints() -> F.Column:
    """Winnowed fingerprints of g: the 32-bit hash above, the position below."""
    mask = F.lit(-(1 << 32))
    keys = F.transform("g", lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("long")))
    return F.transform(F.array(keys), lambda k: F.array_distinct(F.transform(upto(F.size("g") - (SPAN - 1)), lambda i: F.least(*[F.get(k, i + j) for j in range(SPAN)]))))[0]


def spread(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row a fingerprint: fp (32 bits), pos, and around: the hashes of windows pos-5 .. pos (null outside)."""
    return df.select(*keep, F.explode(fingerprints()).alias("key"), "w").select(
        *keep,
        F.shiftright("key", 32).cast("int").alias("fp"),
        F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"),
        F.transform(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda j: F.get(F.col("w"), (F.col("key").bitwiseAND(0xFFFFFFFF) - (SPAN - 1) + j).cast("int"))).alias("around"),
    )


def starts_of(m: int, marks: list[int]) -> F.Column:
    """(start, len, win) of the windows of m words whose first word is marked."""
    cells = F.array(*[F.lit(x).cast("long") for x in marks])

    def marked(i) -> F.Column:
        k = F.pmod(F.get("h", i), F.lit(MARKS))
        return F.call_function("shiftrightunsigned", F.get(cells, F.floor(k / 64).cast("int")), (k % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    at = F.filter(upto(F.size("h") - (m - 1)), marked)
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(m).alias("len"), F.xxhash64(F.slice(F.col("h"), i + 1, m)).alias("win")))


def small(df: DataFrame) -> DataFrame:
    """Broadcast what was counted to be small; else a shuffled hash join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def document_hits(docs: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dkey, start, len, win): windows of documents that are windows of items; (win, item_id): the items of windows.

    docs has dkey and text, bench has item_id and text.
    """
    items = bench.select("item_id", "text")
    n = F.size(words(F.col("text")))
    b = written(hashed(items.withColumn("n", n).filter("n > 0"), "text"), "bench")
    own = F.when(F.col("n") < WINDOW, F.array(F.xxhash64(F.col("h")))).otherwise(F.col("w"))
    windows = written(b.select("item_id", F.explode(own).alias("win"), F.least("n", F.lit(WINDOW)).alias("len")).distinct(), "windows")
    # full windows: fingerprints meet, then the windows that hold them are compared
    prints = spread(b.filter(F.col("n") >= WINDOW), []).select("fp", "around").distinct()
    grouped = written(prints.select("fp", F.explode("around").alias("win")).dropna().distinct(), "prints")
    d = spread(hashed(docs, "text"), ["dkey"])
    met = d.join(small(grouped.select("fp").distinct()), "fp").select("dkey", "fp", "pos", F.posexplode("around").alias("j", "win")).dropna(subset=["win"])
    full = met.join(small(grouped), ["fp", "win"]).select("dkey", (F.col("pos") - (SPAN - 1) + F.col("j")).alias("start"), F.lit(WINDOW).alias("len"), "win")
    # short items: of each length that occurs, the words that begin one
    cell = F.pmod(F.get("h", F.lit(0)), F.lit(MARKS))
    bits = b.filter(F.col("n") < WINDOW).select("n", F.floor(cell / 64).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int")).alias("bit"))
    marks: dict[int, list[int]] = {}
    for r in bits.groupBy("n", "cell").agg(F.bit_or("bit").alias("bits")).collect():  # nine lengths of MARKS / 64 rows at most
        marks.setdefault(r.n, [0] * (MARKS // 64))[r.cell] = r.bits
    hits = [full]
    if marks:
        grams = docs.select("dkey", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
        found = grams.select("dkey", F.inline(F.concat(*[starts_of(m, marks[m]) for m in sorted(marks)])))
        side = windows.filter(F.col("len") < WINDOW).select("win", "len").distinct()
        hits.append(found.join(small(side), ["win", "len"]).select("dkey", "start", "len", "win"))
    return reduce(DataFrame.unionByName, hits).distinct(), windows.select("win", "item_id").dropna().distinct()


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its counts; columns other than the text are kept."""
    keep = [c for c in docs.columns if c not in (text_col, *RESULTS)]
    body = F.coalesce(F.col(text_col), F.lit(""))
    # rows of one id and one text are one document to the joins
    dkey = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.md5(body.cast("binary")).alias("m"))
    hits, items = document_hits(docs.select(dkey.alias("dkey"), body.alias("text")), bench)
    hits = written(hits, "hits")
    w = Window.partitionBy("dkey").orderBy("start")
    # overlapping windows: a word counts once, in the first window that reaches past all before it
    reach = hits.groupBy("dkey", "start").agg(F.max("len").alias("len")).withColumn("end", F.col("start") + F.col("len"))
    reach = reach.withColumn("before", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = reach.groupBy("dkey").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))).alias("n_hit"))
    listed = (
        hits.select("dkey", "win").distinct().join(small(items), "win").groupBy("dkey")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        .select("dkey", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    found = written(counts.join(listed.hint("shuffle_hash"), "dkey", "left"), "found")
    base = docs.select(*keep, dkey.alias("_k"), word_count(body).alias("n_words"))
    j = base.join(found.hint("shuffle_hash"), F.col("_k") == F.col("dkey"), "left")
    return j.select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT row_number() OVER () AS bid, item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i AS start, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), h AS (
  SELECT rid, start, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), n AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(start, start + m)) AS p FROM h) GROUP BY rid
), li AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n.rid IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN li USING (rid)
"""
