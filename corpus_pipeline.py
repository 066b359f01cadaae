"""Corpus preparation: the stages that turn `documents` into clean, encoded text.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's docs. All stages but the
last return the columns of documents, also ones that are not named here: a row
travels as one struct, so no column's name can clash with what a stage adds.

Defined results of every stage: a null text is an empty one, which is not toxic,
is a near copy of other empty ones, is not cut or contaminated, and has no
pieces; rows without an id, and rows that share one, are documents of their own;
of rows that repeat a document whole, near-dedup keeps one; ties go to the
smaller id, then to the smaller text hash; a very long text is taken whole; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import bwtdedup, nearsets, nnpu, spviterbi, winnow
from threadline.llm.common import table, written


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _whole): the two columns that stages read, and the whole row."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned outside the held-out third, does not call toxic."""
    model = nnpu.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), nnpu.fold("doc_id", 3) != 1)
    return nnpu.score(wrapped(docs), model).filter("predicted = 0").select("_whole.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at five-word-shingle similarity 0.8: the first by doc_id (null last) and text hash, of repeated rows one."""
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = wrapped(docs).withColumn("_row", key)
    found = nearsets.near_sets(rows, "_row", shingle=5, least=0.8)
    keep = found.groupBy("root").agg(F.min("_row").alias("_keep")).select(F.col("_keep.no").alias("_no"), F.coalesce("_keep.id", F.lit(0)).alias("_id"), F.col("_keep.hash").alias("_hash"))
    on = (F.col("_row.no") == F.col("_no")) & (F.coalesce("_row.id", F.lit(0)) == F.col("_id")) & (F.col("_row.hash") == F.col("_hash"))
    return rows.join(keep.hint("shuffle_hash"), on, "left_semi").dropDuplicates(["_row"]).select("_whole.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; n_chars follows; emptied documents go."""
    left = bwtdedup.cleaned(wrapped(docs).withColumn("_whole", F.col("_whole").dropFields("text")))  # the text comes back as what is kept
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("_whole.n_chars"))
    out = left.filter((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    return out.select(*[F.col("kept").alias("text") if c == "text" else n_chars.alias("n_chars") if c == "n_chars" else F.col(f"_whole.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words (or a whole shorter item) with the benchmark."""
    found = winnow.contamination(wrapped(docs), table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select("_whole.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document (null text: none), with their checksum and whether they decode to the text again."""
    checked = spviterbi.encode_and_check(F.col("text"), spviterbi.default_model())
    return docs.select("doc_id", "lang", "source", checked.alias("_c")).select("doc_id", "lang", "source", "_c.n_pieces", "_c.ids_crc32", "_c.exact", "_c.ids")


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: A classifier and a fixed point over all pairs are not SQL; tests compare the near-duplicate stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
