"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

A is a byte-level BPE file of the tokenizers library, B a SentencePiece model;
both see a blank and then the text. Where a token of A and a token of B end at
the same byte, both lists are cut: the stretch between two such places is a
group. Ends go into a dictionary of each list (end to index), the keys that
both have are the cuts, in order, and slices of both lists are the groups; in a
group every pair of tokens whose bytes overlap is a link.

A text falls into stretches at blanks that neither tokenizer joins across, and
a distinct stretch of a run of texts is encoded and aligned once; texts are sums
over their stretches. A run writes its documents, as numbers of stretches, and
what its stretches link: every pair of ids once, with the number of the run's
documents that hold it. Pairs are summed over the runs, the highest count of
every A id is taken, and each run asks for its pairs' counts, which it applies
to its stretches and so to its documents. So a pair meets as many rows as there
are runs, not documents, and a run (2 MB of texts, or one longer text) is the
most that a task holds; beside it, a bounded memory of stretches met before.

Defined results: texts that are null or empty, or whose tokens' bytes under
either tokenizer are not the blank and the text (a literal U+2581), have no
tokens: zeros, and an empty digest; added tokens' strings are plain text;
repeated rows are documents of their own, so they count for pairs as often;
null ids stay; very long texts and words are aligned whole; an empty table
gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import distinct_parts, give_back, lists, runs, spread
from .common import table, written
from .revsearch import term_counts
from .tokenfile import cut_places
from .tokenfst import byte_letters

MARK = "▁"
#: Bytes of texts in a run, and distinct stretches that are encoded together.
RUN, TOGETHER = 1 << 21, 1 << 14
#: Bytes of remembered stretches before they become the old ones, from which what is still in use moves on; what one takes beside its text and result.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 160
HEAD = struct.Struct("<4i")
RUN_ROW = "run long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, kinds array<int>, times array<long>, pairs array<long>, freq array<long>, links array<int>, sizes array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Groups as (first, end) of both lists, and links as pairs of ids (A's above B's 32 bits), of tokens that end at these bytes."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a) + 1), strict=True)), dict(zip(b_ends, range(1, len(b) + 1), strict=True))
    groups, links = [], []
    i = j = 0
    for end in sorted(a_at.keys() & b_at.keys()):
        i_end, j_end = a_at[end], b_at[end]
        groups.append((i, i_end, j, j_end))
        k = j
        for x in range(i, i_end):
            upper, until = a[x] << 32, a_ends[x]
            links.append(upper | b[k])
            while b_ends[k] < until:
                k += 1
                links.append(upper | b[k])
            k += b_ends[k] == until
        i, j = i_end, j_end
    return groups, links


def whole(strings: pa.LargeBinaryArray) -> bytes:
    """Strings that were taken one by one, end to end."""
    return bytes(memoryview(strings.buffers()[2])) if len(strings) else b""


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()  # ids without bytes spell nothing
        for t, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else b""
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [b""] * self.b.get_piece_size()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i)):
                self.b_bytes[i] = piece.replace(MARK, " ").encode()
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece goes on after a blank; stretches would not be independent")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_spelled, self.b_spelled = pa.array(self.a_bytes, pa.large_binary()), pa.array(self.b_bytes, pa.large_binary())
        self.said = pa.array([b"%d%s" % (i, after) for n, kinds in ((len(self.a_bytes), b",|"), (len(self.b_bytes), b",;")) for after in (kinds[:1], kinds[1:]) for i in range(n)], pa.large_binary())

    def encoded(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of stretches, each of which begins with the blank that B puts there itself."""
        return [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)], self.b.encode([s[1:] for s in stretches], num_threads=1)

    def stretch(self, text: str, a: list[int], b: list[int]) -> bytes:
        """HEAD (how many ids of A, of B, groups and links), the links, and the groups as text; -1 groups if a token list does not spell the stretch."""
        a_raw, b_raw = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        raw = text.encode()
        if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            return HEAD.pack(0, 0, -1, 0)
        groups, links = aligned(a, list(accumulate(map(len, a_raw))), b, list(accumulate(map(len, b_raw))))
        x, y = list(map(str, a)), list(map(str, b))
        said = [f"{x[i] if i_end == i + 1 else ','.join(x[i:i_end])}|{y[j] if j_end == j + 1 else ','.join(y[j:j_end])}" for i, i_end, j, j_end in groups]
        return HEAD.pack(len(a), len(b), len(groups), len(links)) + array("q", links).tobytes() + ";".join(said).encode()

    def batch(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[bytes]:
        """What `stretch` gives of each, of all at once.

        Ends are places in all texts end to end. Every stretch of bytes between two
        neighbouring ends of either list is one link: of the tokens that cover it.
        """
        raws = [t.encode() for t in texts]
        size = np.array(list(map(len, raws)), np.int64)
        na, nb = np.array(list(map(len, a)), np.int64), np.array(list(map(len, b)), np.int64)
        x, y = np.array(list(chain.from_iterable(a)), np.int64), np.array(list(chain.from_iterable(b)), np.int64)
        x_size, y_size = self.a_size[x], self.b_size[y]
        x_raw, y_raw, raw = self.a_spelled.take(pa.array(x)), self.b_spelled.take(pa.array(y)), b"".join(raws)
        plain = (x_size > 0).all() and (y_size > 0).all() and np.array_equal(sums(x_size, na), size) and np.array_equal(sums(y_size, nb), size)
        if not raw or not plain or whole(x_raw) != raw or whole(y_raw) != raw:  # some of them are not spelled by their tokens
            if len(texts) == 1:
                return [self.stretch(texts[0], a[0], b[0])]
            half = len(texts) // 2
            return self.batch(texts[:half], a[:half], b[:half]) + self.batch(texts[half:], a[half:], b[half:])
        x_end, y_end, end = np.cumsum(x_size), np.cumsum(y_size), np.cumsum(size)
        ends = np.union1d(x_end, y_end)
        links = (x[np.searchsorted(x_end, ends)] << 32 | y[np.searchsorted(y_end, ends)]).tobytes()
        x_cut, y_cut = np.isin(x_end, y_end, assume_unique=True), np.isin(y_end, x_end, assume_unique=True)
        x_group, y_group = np.cumsum(x_cut) - x_cut, np.cumsum(y_cut) - y_cut
        # ids as text, A's of a group before B's: after each a comma, a bar or a semicolon, which the last of a stretch goes without
        said = np.concatenate((x + len(self.a_bytes) * x_cut, 2 * len(self.a_bytes) + y + len(self.b_bytes) * y_cut))
        said = self.said.take(pa.array(said[np.argsort(np.concatenate((2 * x_group, 2 * y_group + 1)), kind="stable")]))
        until = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1][np.cumsum(na + nb)].tolist()
        said = whole(said)
        groups, n_links = np.diff(np.searchsorted(x_end[x_cut], end, side="right"), prepend=0), np.diff(np.searchsorted(ends, end, side="right"), prepend=0)
        heads = np.stack((na, nb, groups, n_links), axis=1).astype(np.int32).tobytes()
        out, at, begin, h = [], 0, 0, HEAD.size
        for i, (e, stop) in enumerate(zip((8 * np.cumsum(n_links)).tolist(), until, strict=True)):
            out.append(heads[i * h : i * h + h] + links[at:e] + said[begin : stop - 1])
            at, begin = e, stop
        return out

    def results(self, stretches: list[str]) -> list[bytes]:
        """What `stretch` gives of each; remembered ones are not encoded again."""
        if self.held > CACHE_BYTES:
            self.known, self.old, self.held = {}, self.known, 0
        for text in stretches:
            if text not in self.known and text in self.old:
                self.keep(text, self.old[text])
        new = [text for text in stretches if text not in self.known]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            for text, found in zip(some, self.batch(some, *self.encoded(some)), strict=True):
                self.keep(text, found)
        return [self.known[text] for text in stretches]

    def keep(self, text: str, found: bytes) -> None:
        self.known[text] = found
        self.held += len(text) + len(found) + ENTRY_BYTES


_workers: dict[tuple[str, str], Pair] = {}


def stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """How many stretches each text has, which distinct one each is, and those; a text is led by a blank, an empty one has none."""
    raws = [b" " + t.encode() if t else b"" for t in texts]
    raw, size = b"".join(raws), np.array([len(r) for r in raws], np.int64)
    if not raw:
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64), []
    x = np.frombuffer(raw, np.uint8)
    where = np.cumsum(size) - size
    cut = cut_places(x, where[size > 0])
    opens = np.zeros(len(x), bool)
    opens[where[size > 0]] = True
    cut = cut[opens[cut] | ((x[cut] == 32) & (x[cut - 1] != 32))]
    which, kinds = distinct_parts(raw, cut)
    return np.diff(np.searchsorted(cut, np.append(where, len(raw)))), which.astype(np.int64), kinds.to_pylist()


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of neighbouring values, so many each."""
    so_far = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return so_far[ends] - so_far[ends - sizes]


def run_rows(pair: Pair, run: int, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """A row a document, then one for the run."""
    n, which, kinds = stretches(texts)
    found = pair.results(kinds)
    figure = np.frombuffer(b"".join([x[: HEAD.size] for x in found]), np.int32).reshape(-1, 4).astype(np.int64)
    fine, sizes = figure[:, 2] >= 0, figure[:, 3]
    until = (HEAD.size + 8 * sizes).tolist()
    said = [x[e:] for x, e in zip(found, until, strict=True)]
    codes = np.frombuffer(b"".join([x[HEAD.size : e] for x, e in zip(found, until, strict=True)]), np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    good = np.bincount(row[~fine[which]], minlength=len(texts)) == 0
    ends = np.cumsum(n)
    digests = []
    for i, (s, e) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
        digests.append(hashlib.sha256(b";".join([said[k] for k in which[s:e].tolist()])).hexdigest() if good[i] and e > s else "")
    keep = good[row]
    per = lambda values: np.bincount(row[keep], weights=values[which[keep]], minlength=len(texts)).astype(np.int64)  # noqa: E731  counts stay far below 2**53
    pairs, link = np.unique(codes, return_inverse=True)
    # the run's documents that hold each pair
    doc, kind, times = term_counts(np.where(good, n, 0), which[keep], np.arange(len(kinds)), len(kinds))
    reach = sizes[kind]
    held = np.unique(np.repeat(doc * max(len(pairs), 1), reach) + link[spread((np.cumsum(sizes) - sizes)[kind], reach)])
    freq = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))[: len(pairs)]
    m, k = len(texts), np.bincount(doc, minlength=len(texts))
    late = pa.nulls(m, pa.list_(pa.int64()))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    columns = [
        pa.array(np.full(m + 1, run, np.int64)), pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), *[pa.array(np.append(per(v), 0)) for v in figure.T],
        pa.array([*digests, None]), pa.concat_arrays([lists(kind.astype(np.int32), k), pa.nulls(1, pa.list_(pa.int32()))]), pa.concat_arrays([lists(times.astype(np.int64), k), pa.nulls(1, pa.list_(pa.int64()))]),
        pa.concat_arrays([late, one(pairs, pa.int64())]), pa.concat_arrays([late, one(freq, pa.int64())]), pa.concat_arrays([pa.nulls(m, pa.list_(pa.int32())), one(link.astype(np.int32), pa.int32())]), pa.concat_arrays([late, one(sizes, pa.int64())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUN_ROW.split(", ")])


def with_counts(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """A run's documents with what its pairs' corpus-wide counts come to."""
    last = pc.is_valid(rows["pairs"])
    own, docs = rows.filter(last), rows.filter(pc.invert(last))
    link, sizes = own["links"].combine_chunks().flatten().to_numpy(), own["sizes"].combine_chunks().flatten().to_numpy()
    n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
    n[counts["at"].to_numpy()], best[counts["at"].to_numpy()] = counts["n"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    kinds = docs["kinds"].combine_chunks()
    many, kind, times = pc.list_value_length(kinds).to_numpy(), kinds.flatten().to_numpy(), docs["times"].combine_chunks().flatten().to_numpy()
    n_best, count_sum = (sums(times * sums(v[link], sizes)[kind], many) for v in (best.astype(np.int64), n))
    out = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": docs["groups_sha256"]}
    return pa.table(out)


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens, groups and links under both tokenizers, and what the links count corpus-wide."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    most = RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _workers:
            _workers[a_path, b_path] = Pair(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for s, e in runs(pc.binary_length(b.column("text")).to_pylist(), most):
                yield run_rows(_workers[a_path, b_path], number, b.column("doc_id")[s:e], b.column("text")[s:e].to_pylist())
                number += 1
        give_back()

    rows = written(d.mapInArrow(run, RUN_ROW), "stretches")
    asked = rows.filter("pairs is not null").select(F.col("run").alias("of_run"), F.posexplode(F.arrays_zip("pairs", "freq")).alias("at", "p")).select("of_run", "at", F.col("p.pairs").alias("pair"), F.col("p.freq").alias("freq"))
    totals = asked.groupBy("pair").agg(F.sum("freq").alias("n"))
    counts = totals.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))
    told = asked.select("of_run", "at", "pair").join(counts.hint("merge"), "pair").select("of_run", "at", "n", "best")
    return rows.groupBy("run").cogroup(told.groupBy("of_run")).applyInArrow(with_counts, RESULT)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the byte-level file and the SentencePiece file."""
    import public_tokenizers

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
