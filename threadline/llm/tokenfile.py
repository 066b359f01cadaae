"""Token-id files: Parquet with a list column of ids, made for selective reads.

Texts are encoded with a byte-level BPE file of the tokenizers library. A run
of texts is cut, over its bytes at once, at places that the pre-tokeniser never
joins across; each distinct part that this worker does not remember is given to
the library, many to a call. The ids are the same as those of the whole text.

Files: rows range-partitioned and sorted by id, one list column `ids`, delta
encoding for numbers (or a dictionary), bounded row groups and pages, page
indexes with each column chunk; so a reader can skip by id, and can read
`n_tokens` without touching the ids.

Defined results: a null text is empty and encodes to the end id alone; null
ids come first; rows that share an id are ordered by their text; repeated rows
are documents of their own; an empty table gives empty files; further columns
are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import checksums, distinct_parts, lists, runs, spread
from .common import partitions, scratch, table

#: Bytes of remembered parts before they become the old ones, from which what is still in use moves on.
CACHE_BYTES = 48 << 20
#: What one remembered part takes beside its text and ids.
ENTRY_BYTES = 160
#: Parts that are given to the library as one text.
GROUP = 256
_workers: dict = {}

#: Classes of bytes: apostrophe, space, other white space, letters, digits, other ASCII, all else (never cut).
QUOTE, BLANK, BREAK, LETTER, DIGIT, MARK, OTHER = range(7)


def byte_classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        c[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    c[ord("'")], c[ord(" ")] = QUOTE, BLANK
    c[9:14] = BREAK
    return c


def borders() -> np.ndarray:
    """Whether a part ends between two classes, whatever stands around; blanks and breaks have rules of their own."""
    t = np.zeros((7, 7), bool)
    for a, b in ((LETTER, DIGIT), (LETTER, MARK), (DIGIT, MARK)):
        t[a, b] = t[b, a] = True
    t[[LETTER, DIGIT], QUOTE] = True  # what follows an apostrophe can be a contraction with it; a mark takes it along
    t[[LETTER, DIGIT, MARK, QUOTE], BREAK] = True
    return t.ravel()


CLASS, BORDER = byte_classes(), borders()
#: First bytes of characters of which some are white space: no cut before them.
UNSURE = np.zeros(256, bool)
UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cut_places(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First bytes of the parts of texts that stand end to end and begin at `start`.

    The pre-tokeniser takes a blank along with what follows it, so a part
    begins at a blank before a visible character; a single break is a part of
    its own; of longer white space only the last blank is told apart. Letters
    from U+00C0 to U+024F count as such, but for the two signs among them.
    """
    c = CLASS[raw]
    lead = (raw >= 0xC3) & (raw <= 0xC8)
    lead[:-1] &= ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
    lead[-1:] = False
    c[lead] = LETTER
    c[1:][lead[:-1]] = LETTER
    white = (c == BLANK) | (c == BREAK)
    cut = np.zeros(len(raw), bool)
    cut[1:] = BORDER[c[:-1] * 7 + c[1:]]
    cut[:-1] |= (c[:-1] == BLANK) & ~white[1:] & ~UNSURE[raw[1:]] & ((raw[1:] < 0x1C) | (raw[1:] > 0x1F))
    begins = np.zeros(len(raw) + 1, bool)
    begins[start] = True
    # after a single break: what is before it is visible or another text, and so is what comes after it
    lone = c == BREAK
    lone[1:] &= ~white[:-1] | begins[1:-1]
    lone[1:] &= (c[:-1] != OTHER) | begins[1:-1]
    cut[1:] |= lone[:-1] & ~white[1:] & ~UNSURE[raw[1:]] & (c[1:] != OTHER)
    cut[start] = True
    return np.flatnonzero(cut)


class PartEncoder:
    """Encodes runs of texts, asking the library only for parts that it does not remember."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of every id; in a byte-level file a token has a character a byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ask_groups(self, parts: list[str], between: str) -> list[bytes]:
        """Ids of parts that can stand in one text, with something between them that is a token of its own."""
        groups = [parts[at : at + GROUP] for at in range(0, len(parts), GROUP)]
        out: list[bytes] = []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.cumsum([len(p.encode()) + len(between) for p in g])
            last = np.searchsorted(np.cumsum(self.width[ids]), ends - len(between)) + 1
            first = np.concatenate(([0], last[:-1] + len(between)))
            blob = ids.tobytes()
            out += [blob[4 * s : 4 * e] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
        return out

    def learn(self, new: list[str]) -> None:
        led: list[str] = []
        bare: list[str] = []
        rest: list[str] = []
        for p in new:
            if p[0] == " " and p[1:2].isalnum():
                led.append(p)
            elif p.isascii() and not p[0].isspace() and not p[-1].isspace():
                bare.append(p)
            else:
                rest.append(p)
        for parts, ids in ((led, self.ask_groups(led, "")), (bare, self.ask_groups(bare, "\n")), (rest, self.ask(rest))):
            self.known.update(zip(parts, ids, strict=True))
            self.held += sum(map(len, parts)) + sum(map(len, ids)) + ENTRY_BYTES * len(parts)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, `end` after each if there is one, and how many each has."""
        tail = b"" if end is None else np.array([end], np.int32).tobytes()
        if any(s in t for t in texts for s in self.special):
            blobs = [b + tail for b in self.ask(texts)]
            return np.frombuffer(b"".join(blobs), np.int32), np.array([len(b) // 4 for b in blobs], np.int64)
        raws = [t.encode() for t in texts]
        raw, size = b"".join(raws), np.array([len(r) for r in raws], np.int64)
        where = np.cumsum(size) - size
        first = cut_places(np.frombuffer(raw, np.uint8), where[size > 0]) if raw else np.zeros(0, np.int64)
        which, kinds = distinct_parts(raw, first)
        parts = kinds.to_pylist()
        if self.held > CACHE_BYTES:
            self.known, self.old, self.held = {}, self.known, 0
        new = [p for p in parts if p not in self.known]
        moved = [p for p in new if p in self.old]
        self.known.update((p, self.old[p]) for p in moved)
        self.held += sum(map(len, moved)) * 2 + ENTRY_BYTES * len(moved)
        self.learn([p for p in new if p not in self.known])
        blobs = [self.known[p] for p in parts] + [tail]
        count = np.array([len(b) for b in blobs], np.int64) // 4
        pool, begin = np.frombuffer(b"".join(blobs), np.int32), np.cumsum(count) - count
        # the parts of all texts in their order, each text's followed by the one that is the end
        until = np.searchsorted(first, where + size)
        which = np.insert(which, until, len(parts))
        n = count[which]
        total = np.concatenate(([0], np.cumsum(n)))[until + np.arange(1, len(texts) + 1)]
        return pool[spread(begin[which], n)], np.diff(total, prepend=0)


def encoder(path: str) -> PartEncoder:
    if path not in _workers:
        _workers[path] = PartEncoder(path)
    return _workers[path]


def encode_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """(part, seq, doc_id, n_tokens, ids): sorted by id over the partitions, end_id appended to each document."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            for s, e in runs(pc.binary_length(b.column("text")).to_pylist()):
                ids, count = enc.encode(b.column("text")[s:e].to_pylist(), end_id)
                k = e - s
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(seq, seq + k, dtype=np.int64)), b.column("doc_id")[s:e], pa.array(count), lists(ids, count)],
                    names=["part", "seq", "doc_id", "n_tokens", "ids"],
                )
                seq += k

    return d.mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids array<int>")


def write_token_files(tokens: DataFrame, path: str, row_group_mb: int = 16, page_kb: int = 256, delta: bool = True) -> None:
    """Write tokens in their order; delta encoding or else a dictionary for numbers, with page indexes."""
    tokens.write.options(**{
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": str(not delta).lower(),
        "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10), "compression": "zstd",
    }).parquet(path)


def starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of token files with `start`, the number of ids before the row: running sums within parts, then the parts' offsets.

    Only `part`, `seq` and `n_tokens` are needed for it, and for the offsets
    `part` and `n_tokens` of all rows (sizes). The side that is broadcast has a
    row a part, so as many rows as there are partitions.
    """
    per = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("own")).drop("own", "base")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, n_tokens, start) of all rows; the id lists are not read."""
    t = spark.read.parquet(path).select("part", "seq", "doc_id", "n_tokens")
    return starts(t, t)


def read_token_files(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Token rows; with bounds only those ids' rows, for which files, row groups and pages are skipped by their statistics."""
    t = spark.read.parquet(path)
    for bound, over in ((first_id, F.col("doc_id") >= F.lit(first_id)), (last_id, F.col("doc_id") <= F.lit(last_id))):
        t = t if bound is None else t.filter(over)
    return t


def starts_and_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), counts and checksums from the ids in the files."""
    t = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = pc.list_value_length(b.column("ids")).to_numpy().astype(np.int64)
            crc = checksums(b.column("ids").flatten().to_numpy(), count)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), b.column("doc_id"), pa.array(count), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    read = t.select("part", "seq", "doc_id", "ids").mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    return starts(read, t.select("part", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in id order and digested from the files."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_token_files(encode_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2), path)
    return starts_and_digests(spark, path)
