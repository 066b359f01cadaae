"""Ranked lexical search the other way round: the queries are indexed, the documents stream by.

The items' terms form an inverted index (term to items and how often each asks
for it). It is broadcast; every document's term counts pass through it, and each
task keeps a heap of its best documents for every item. The heaps of all tasks,
`k` rows an item and task at most, are merged by item.

Items go in blocks, as many as it takes for each block's index to hold at most
BLOCK_POSTINGS postings and BLOCK_ITEMS items (counted before anything is
broadcast; an item that is larger by itself is a block of its own). A block is
one reading of the texts, which leaves each document's length and its counts of
the block's terms; document frequencies and scores come from these. Nothing
grows with the documents but what stays spread over the tasks.

Terms are maximal runs of ASCII letters, digits and other characters than
ASCII; only A-Z are lower-cased. Scores are integers, as the formula in
`Index.parts` gives them.

Defined results: a null or empty text has no terms, and a document without
terms counts for nothing; an item without terms, or whose terms occur nowhere,
has no rows; rows that repeat an item are ranked each for itself, rows that
repeat a document are documents of their own; of equal scores the smaller
doc_id goes first, null last; empty tables give an empty one; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import distinct_parts, give_back, lists, runs, spread
from .common import table, written

#: What one broadcast index may hold.
BLOCK_POSTINGS, BLOCK_ITEMS = 500_000, 4096
#: Score cells (documents by items) and postings that are worked on together.
CELLS, TOGETHER = 1 << 20, 1 << 21

WORD = np.zeros(256, bool)
WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
for _c in range(128):
    WORD[_c] = chr(_c).isalnum()
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    LOWER[_c] = _c + 32


def term_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """For texts: how many terms each has, and for all terms in order their number among the distinct ones, and those."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = at[:-1][at[:-1] < len(raw)]  # a text's first byte begins a term, whatever the text before ends with
    first[begins] = word[begins]
    begin = np.flatnonzero(first)
    n = np.diff(np.searchsorted(begin, at))
    within = (np.cumsum(word) - 1)[begin]
    which, kinds = distinct_parts(LOWER[raw[word]].tobytes(), within) if len(begin) else (np.zeros(0, np.int64), pa.array([], pa.large_string()))
    return n, which, kinds


def term_counts(n: np.ndarray, which: np.ndarray, of: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, counts) of terms that `of` numbers from 0 (-1: not wanted), by row and term."""
    term = of[which]
    row = np.repeat(np.arange(len(n)), n)[term >= 0]
    key, count = np.unique(row * max(many, 1) + term[term >= 0], return_counts=True)
    return key // max(many, 1), key % max(many, 1), count


def indexed_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no, item, terms, asked): every item with its distinct terms and how often it asks for each; items without terms go."""
    i = items.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, which, kinds = term_runs(b.column("text"))
            row, term, count = term_counts(n, which, np.arange(len(kinds)), len(kinds))
            sizes = np.bincount(row, minlength=b.num_rows)
            terms = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), kinds.take(pa.array(term)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("no"), b.column("item"), terms, lists(count.astype(np.int64), sizes)], names=["no", "item", "terms", "asked"])

    kind = i.schema["item"].dataType.simpleString()
    return i.mapInArrow(run, f"no long, item {kind}, terms array<string>, asked array<long>").filter(F.size("terms") > 0)


def blocks(items: DataFrame) -> list[DataFrame]:
    """Items in parts whose postings and rows are counted to fit one index."""
    n = 1
    while True:
        part = F.pmod(F.xxhash64("no"), F.lit(n))
        row = items.groupBy(part.alias("part")).agg(F.sum(F.size("terms")).alias("p"), F.count("*").alias("i")).agg(F.max("p"), F.max("i"), F.sum("i")).first()
        if row[2] is None:
            return []
        if (row[0] <= BLOCK_POSTINGS and row[1] <= BLOCK_ITEMS) or row[1] == 1:
            return [items.filter(part == k) for k in range(n)]
        n *= 2


class Index:
    """One block's inverted index: postings by term, with the corpus's figures once they are counted."""

    def __init__(self, block: pa.Table):
        self.ids, self.no = block["item"].combine_chunks(), block["no"].to_numpy()
        terms = block["terms"].combine_chunks()
        sizes = pc.list_value_length(terms).to_numpy()
        coded = terms.flatten().dictionary_encode()
        self.terms = coded.dictionary
        term = coded.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.items = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.asked = block["asked"].combine_chunks().flatten().to_numpy()[order]
        self.size = np.bincount(term, minlength=len(self.terms))
        self.begin = np.cumsum(self.size) - self.size

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def parts(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each of a document's terms adds to an item that asks for it once."""
        m = 100 - 75 + (75 * n * self.n_docs) // self.n_terms
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))


def counted(docs: DataFrame, terms: pa.StringArray, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tf) of every document that has terms: its length in terms, and its counts of the index's terms."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    wanted = d.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value.cast(pa.large_string())
        for b in batches:
            for s, e in runs(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
                n, which, kinds = term_runs(b.column("text")[s:e])
                of = pc.fill_null(pc.index_in(kinds, value_set=known), -1).to_numpy().astype(np.int64)
                row, term, tf = term_counts(n, which, of, len(known))
                sizes = np.bincount(row, minlength=e - s)
                out = pa.RecordBatch.from_arrays([b.column("doc")[s:e], pa.array(n.astype(np.int64)), lists(term.astype(np.int32), sizes), lists(tf.astype(np.int64), sizes)], names=["doc", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))
        give_back()

    return d.mapInArrow(run, "doc long, n long, terms array<int>, tf array<long>")


class Heaps:
    """The best k documents of every item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)  # what a score must reach: 1, or the worst of k
        self.held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))  # item, score, no id, id

    def push(self, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (rows) for all items (columns)."""
        floor = self.floor
        if len(score) > self.k:
            floor = np.maximum(floor, np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k])
        row, item = np.nonzero(score >= floor)
        if not len(row):
            return
        joined = [np.concatenate(x) for x in zip(self.held, (item, score[row, item], no_id[row], ids[row]), strict=True)]
        order = np.lexsort((joined[3], joined[2], -joined[1], joined[0]))
        item, value, no, doc = (x[order] for x in joined)
        begin = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
        self.held = tuple(x[place < self.k] for x in (item, value, no, doc))
        last = place == self.k - 1
        self.floor[item[last]] = value[last]


def best_of_tasks(counts: DataFrame, index: Index, k: int, kind: str) -> DataFrame:
    """(no, item_id, doc, score): each task's best k documents of every item."""
    shared = counts.sparkSession.sparkContext.broadcast(index)
    cells, together = CELLS, TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        many = len(ix.ids)
        heaps = Heaps(many, k)
        for b in batches:
            sizes = pc.list_value_length(b.column("terms")).to_numpy().astype(np.int64)
            term, tf = b.column("terms").flatten().to_numpy(), b.column("tf").flatten().to_numpy()
            n, no_id, ids = b.column("n").to_numpy(), b.column("doc").is_null().to_numpy(zero_copy_only=False), pc.fill_null(b.column("doc"), 0).to_numpy()
            row = np.repeat(np.arange(b.num_rows), sizes)
            part, reach = ix.parts(n, row, term, tf), ix.size[term]
            until, so_far = np.cumsum(sizes), np.concatenate(([0], np.cumsum(reach)))
            most = (so_far[until] - so_far[until - sizes]).tolist()
            step = max(1, cells // many)
            for s0, e0 in runs(most, together):
                for s in range(s0, e0, step):
                    e = min(s + step, e0)
                    lo, hi = int(until[s] - sizes[s]), int(until[e - 1])
                    score = np.zeros((e - s, many), np.int64)
                    at = spread(ix.begin[term[lo:hi]], reach[lo:hi])
                    cell = np.repeat((row[lo:hi] - s) * many, reach[lo:hi]) + ix.items[at]
                    np.add.at(score.reshape(-1), cell, np.repeat(part[lo:hi], reach[lo:hi]) * ix.asked[at])
                    heaps.push(score, no_id[s:e], ids[s:e])
        item, value, no, doc = heaps.held
        yield pa.RecordBatch.from_arrays([pa.array(ix.no[item]), ix.ids.take(pa.array(item)), pa.array(doc, mask=no), pa.array(value)], names=["no", "item_id", "doc", "score"])
        give_back()

    return counts.mapInArrow(run, f"no long, item_id {kind}, doc long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    indexed = written(indexed_items(items, item_col, item_text), "items")
    kind = indexed.schema["item"].dataType.simpleString()
    found = spark.createDataFrame([], f"no long, item_id {kind}, doc long, score long")
    for block in blocks(indexed):
        index = Index(block.toArrow())
        counts = written(counted(docs, index.terms, id_col, text_col), "counts")
        total = counts.agg(F.count("*"), F.sum("n")).first()
        if not total[0]:
            break
        df = np.zeros(len(index.terms), np.int64)
        per = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row a term of the index
        df[per["term"].to_numpy()] = per["count"].to_numpy()
        index.weigh(total[0], total[1], df)
        found = found.unionAll(best_of_tasks(counts, index, k, kind))
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, out of all documents."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
s as (select count(*) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d where len(terms) > 0),
q as (
  select item_id, term, count(*) as asked
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null)
  group by item_id, term),
t as (
  select doc_id, n, term, count(*) as tf
  from (select doc_id, len(terms) as n, unnest(terms) as term from d)
  where term in (select term from q) group by doc_id, n, term),
w as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from t, s group by term, n_docs),
r as (
  select item_id, doc_id, cast(sum(asked * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) as bigint) as score
  from q join t using (term) join w using (term), s group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from r where score > 0
qualify rank <= 10
"""
