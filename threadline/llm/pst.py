"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are words (A-Z in lower case) and one end a document, which is also the
context of the first word. A context is a run of up to DEPTH words. Level by
level, contexts seen at least CONTEXT_MIN times are counted over the whole
corpus with what follows them; one is kept if its next-word distribution
diverges from its parent's (the context one word shorter) by more nats in all
than a BIC term for its successors, and so are the suffixes of kept ones. All
successors seen at least SUCCESSOR_MIN times are listed. The mass of the others
goes to the back-off weight, as PULL tokens do, and so by the parent's
distribution to all words: with total T and unlisted mass L,
P(x | c) = n / (T + PULL) + (L + PULL) / (T + PULL) P(x | parent), which sums to
one. The root has absolute discounting, whose freed mass is the unknown word's,
as in the base score one symbol. A word is scored in its longest kept suffix.

The counts needed are absolute, so the tree grows with the corpus. It stays in
Spark tables keyed by 64-bit hashes of word runs. Scores are sums of looked-up
logarithms: every kept context adds its back-off weight and every listed
successor its gain over backing off.

Shuffles carry packed arrays (module packed): a run of texts sends each bucket
one row that holds its distinct (context, next word) pairs with their counts,
or its lookups, as binary columns. A bucket is a share of the hashes of
contexts or keys; the pairs of contexts that hold HOT_CONTEXT of all tokens are
dealt by the pair, so no context has a task of its own. Tables are deleted once
all that is made of them is written. What is broadcast has a bound
whatever the corpus: words and entries that hold a share of all tokens
(BROADCAST_SHARE, HOT_SHARE), hot contexts, and bit filters of FILTER_BITS that
keep what is surely not in a table out of shuffles; a false hit costs a few
bytes, not a result.

Defined results: null texts are empty, with the end as only token; rows with a
null id are learned from and not held out; repeated rows each count and each
get a row; with nothing to learn from, counts are zero, the base score is that
of its formula and the score is zero; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import give_back, runs
from .common import discard, discard_part, partitions, release, table, written
from .packed import LOW48, PACKED, as_longs, bucket_of, buckets, columns_of, dealt, gathered, met, narrow, pack, slices, widened

DEPTH, CONTEXT_MIN, SUCCESSOR_MIN, PULL = 3, 5, 2, 20.0
#: Shares of all tokens from which words and entries are broadcast, and contexts are dealt by their pairs.
BROADCAST_SHARE, HOT_SHARE, HOT_CONTEXT = 5e-7, 5e-7, 1e-4
#: Bits of a filter (16 MB), and of one part of it as it is made.
FILTER_BITS, PART_BITS = 27, 18
#: Bytes of texts whose pairs are counted together before they are shuffled.
COUNT_RUN = 1 << 23
#: Bytes of texts that are scored together.
SCORE_RUN = 1 << 22
#: A-Z to lower case, and all white space to blanks.
TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: The end token's place among words: it has a space, which no word has.
END_TOKEN = b" end"
U = np.uint64


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words (binary or strings of 64-bit offsets): polynomials of their bytes, mixed."""
    if not len(words):
        return np.zeros(0, U)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].astype(U) + U(1)
    size = np.diff(at)
    begin = at[:-1] - at[0]
    power = np.cumprod(np.full(int(size.max()), U(0x9E3779B97F4A7C15)))
    return mixed(np.add.reduceat(raw * power[np.arange(len(raw)) - np.repeat(begin, size)], begin))


def words_array(words: list[bytes] | pa.Array) -> pa.LargeBinaryArray:
    return words.cast(pa.large_binary()) if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())


class Words:
    """The words of a run of texts: distinct ones (A-Z in lower case), which of them stands where, and words a text."""

    def __init__(self, texts: list[str]):
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([0] + [len(r) for r in raws]).astype(np.int64)
        low = pa.Array.from_buffers(pa.large_string(), len(raws), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(raws).translate(TO_LOWER))])
        parts = pc.split_pattern(low, " ")
        coded = parts.values.dictionary_encode()
        which, self.kinds = coded.indices.to_numpy(), coded.dictionary
        bounds = parts.offsets.to_numpy().astype(np.int64)
        none = pc.index(self.kinds, pa.scalar("", pa.large_string())).as_py()
        if none >= 0:  # between two blanks, before the first word, after the last
            word = which != none
            bounds = np.concatenate(([0], np.cumsum(word)))[bounds]
            which = which[word]
            which = which - (which > none)
            self.kinds = self.kinds.take(pa.array(np.delete(np.arange(len(self.kinds)), none)))
        self.which, self.count = which, np.diff(bounds)

    def keys(self) -> np.ndarray:
        return word_keys(self.kinds)

    def tokens(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (48 bits) of the texts' words end to end, each text between an end that is a context only and its end token; and the place of the first of these."""
        size = self.count + 2
        start = np.cumsum(size) - size
        flat = np.full(int(size.sum()), END_KEY & LOW48, U)
        own = np.repeat(start + 1 - (np.cumsum(self.count) - self.count), self.count)
        flat[own + np.arange(len(self.which))] = keys[self.which] & LOW48
        return flat, np.repeat(start, size)


END_KEY = word_keys(words_array([END_TOKEN]))[0]


def word_runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int, Words]]:
    for s, e in runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most):
        yield s, e, Words([t or "" for t in texts[s:e].to_pylist()])
        give_back()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Packed (word's key, n) over all tokens; a run of texts is counted before it is sent."""
    n_buckets = buckets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, w in word_runs(b.column(0), COUNT_RUN):
                yield pack(as_longs([np.append(w.keys(), END_KEY), np.append(np.bincount(w.which, minlength=len(w.kinds)), e - s)]), 0, n_buckets)

    def total(x: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(x[0])
        first = np.flatnonzero(np.concatenate(([True], np.diff(x[0][order]) != 0)))
        return [x[0][order][first], np.add.reduceat(x[1][order], first)]

    return met([docs.select(text_col).mapInArrow(run, PACKED)], [2], total)


def longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run with one more word at its end."""
    return mixed(run * U(0x9E3779B97F4A7C15) + word)


def before(x: np.ndarray) -> np.ndarray:
    """Values of the position before; the first has none and is never a token."""
    return np.concatenate((x[:1], x[:-1]))


def run_hashes(h: np.ndarray, start: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 .. most words the hash of the run that ends at each position, and whether its document has so many words."""
    place = np.arange(len(h))
    g = mixed(h)
    yield g, np.ones(len(h), bool)
    for k in range(1, most):
        g = longer(before(g), h)
        yield g, place - k >= start


def weight_key(g: np.ndarray) -> np.ndarray:
    """Key of a context's back-off weight, apart from that of the same run as a successor."""
    return mixed(g ^ U(0x5851F42D4C957F2D))


def bit_filter(rows: DataFrame, keys: Callable[..., np.ndarray], columns: int = 0) -> np.ndarray:
    """Bits of the keys' low FILTER_BITS bits, gathered in parts; `keys` gives those of a batch, or of a packed row of so many columns."""
    n, width, part_width = partitions(rows.sparkSession), FILTER_BITS, PART_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.sort(np.concatenate([keys(x) for x in (columns_of(b, columns) if columns else [b])] or [np.zeros(0, U)]) & U((1 << width) - 1))
            part = (low >> U(part_width)).astype(np.int32)
            cut = slices(part)
            bit = (low & U((1 << part_width) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([int(part[s]) for s, _ in cut], pa.int32()), pa.array([bit[s:e].tobytes() for s, e in cut], pa.binary())], names=["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(part, np.zeros(1 << part_width, bool))[np.frombuffer(bits, np.int32)] = True
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    out = np.zeros(1 << (width - 3), np.uint8)
    step = 1 << (part_width - 3)
    for r in rows.mapInArrow(places, schema).repartitionById(n, "part").mapInArrow(run, schema).collect():  # one row a part, all of one filter's size
        out[r.part * step : (r.part + 1) * step] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & U(8 * len(bits) - 1)
    return (bits[(low >> U(3)).astype(np.int64)] >> (low & U(7)).astype(np.uint8)) & 1 == 1


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and whether the key stands there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


PAIRS = "bucket int, level int, ctx binary, size binary, word binary, n binary"


def level_counts(docs: DataFrame, depths: tuple[int, ...], frequent: np.ndarray, hot: np.ndarray, repeated: np.ndarray | None = None) -> DataFrame:
    """Packed (ctx, word, n), the level as side: successors seen SUCCESSOR_MIN times of contexts of `depths` words that can be seen CONTEXT_MIN times.

    frequent: a filter of the runs of depths[0] words that are; a longer context
    must have such a run at both its ends. hot: those runs, sorted, that hold a
    share of all tokens; the pairs of contexts made of them are dealt to all
    buckets. repeated: a filter of the runs of depths[0] words that occur twice,
    among which the run that ends a longer pair must be.
    """
    n_buckets, least = buckets(docs), min(depths)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, hot, repeated))
    names = ["bucket", "level", "ctx", "size", "word", "n"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, split, twice = shared.value
        for b in batches:
            for _, _, w in word_runs(b.column(0), COUNT_RUN):
                h, start = w.tokens(w.keys())
                token = start < np.arange(len(h))
                rows: list[tuple] = []
                often = apart = None
                for d, (g, long) in enumerate(run_hashes(h, start, max(depths)), 1):
                    ctx, fits = before(g), before(long)
                    if d == least:
                        often, apart = may_hold(bits, ctx), found_in(split, ctx)[1]
                        if twice is not None:
                            token &= may_hold(twice, g)
                    elif d > least:  # the run at the end of the context, and the one at its beginning
                        often, apart = often & before(often), apart & before(apart)
                    if d in depths:
                        use = np.flatnonzero(token & fits & often)
                        rows += list(of_level(d, ctx[use], h[use], apart[use]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i > 1 else pa.int32()) for i in range(6)], names=names)

    def of_level(d: int, ctx: np.ndarray, word: np.ndarray, apart: np.ndarray) -> Iterator[tuple]:
        g = longer(ctx, word)
        order = np.argsort(g)
        g = g[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))[: len(g)])
        count, use, g = np.diff(np.append(first, len(g))).astype(np.int32), order[first], g[first]
        c = ctx[use]
        deal = bucket_of(np.where(apart[use], g, c), n_buckets)
        # by bucket, then by context; contexts alike in their upper bits can come in several stretches
        order = np.argsort((deal.astype(U) << U(44)) | (c >> U(20))) if n_buckets < 1 << 20 else np.lexsort((c, deal))
        c, deal, count, use = c[order], deal[order], count[order], use[order]
        for s, e in slices(deal):
            ends = np.array([x for x, _ in slices(c[s:e])] + [e - s])
            at = s + ends[:-1]
            yield int(deal[s]), d, c[at].tobytes(), np.diff(ends).astype(np.int32).tobytes(), narrow(word[use[s:e]]), count[s:e].tobytes()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for b in batches:
            for k, d, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (k, d) != at:
                    yield counted(at[1], held)
                    held = []
                at = k, d
                held.append(row)
        if held:
            yield counted(at[1], held)

    def counted(d: int, rows: list[tuple]) -> pa.RecordBatch:  # in the buckets that the pairs came in
        ctx, size, count = (np.frombuffer(b"".join(r[i] for r in rows), k) for i, k in ((0, U), (1, np.int32), (3, np.int32)))
        ctx, word = np.repeat(ctx, size), widened(b"".join(r[2] for r in rows))
        order = np.argsort(longer(ctx, word))
        ctx, word, count = ctx[order], word[order], count[order].astype(np.int64)
        new = np.ones(len(ctx), bool)
        new[1:] = (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(count, first)
        first = first[count >= SUCCESSOR_MIN]
        count = count[count >= SUCCESSOR_MIN]
        return pack(as_longs([ctx[first], word[first], count]), d, n_buckets)

    packed = docs.mapInArrow(pairs, PAIRS).repartitionById(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "level")
    return packed.mapInArrow(merged, PACKED)


def column(b: pa.RecordBatch, name: str) -> np.ndarray:
    x = b.column(name).to_numpy(zero_copy_only=False)
    return x.view(U) if x.dtype == np.int64 else x


def parent_run(up: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The run of context and word without its first word."""
    return np.where(up == U(0), mixed(word), longer(up, word))


def values_at(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes their number in a table of (key, double) columns, and whether they are in it."""
    own = table[0].view(U)
    order = np.argsort(own)
    at, hit = found_in(own[order], keys.view(U))
    return (table[1].view(np.float64)[order][at] if len(order) else np.ones(len(keys))), hit


def run_key(x: np.ndarray) -> np.ndarray:
    """The runs of listed (ctx, word, n)."""
    return longer(x[0].view(U), x[1].view(U))


def first_key(x: np.ndarray) -> np.ndarray:
    """The runs of single words (key, n)."""
    return mixed(x[0].view(U) & LOW48)


def often(x: np.ndarray, least: float = CONTEXT_MIN) -> np.ndarray:
    """The columns whose last, a count, is large enough."""
    return x[:, x[-1] >= least]


def at_contexts(x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of x (its first are contexts) that stand in the table, and the table's further columns for them."""
    order = np.argsort(t[0].view(U))
    at, hit = found_in(t[0].view(U)[order], x[0].view(U))
    return x[:, hit], t[1:, order[at[hit]]] if len(order) else np.zeros((len(t) - 1, 0), np.int64)


def tested_contexts(s: DataFrame, parents: DataFrame, contexts: DataFrame, above: DataFrame | None) -> DataFrame:
    """(ctx, up, total, rest, kept) of one level: the divergence test.

    parents: packed (run, number) of the level above: counts, or at the root
    probabilities. contexts: packed (ctx, count, up) of those that are seen often
    enough; up is the context one word shorter, 0 for none. above: this table of
    the level above, whose totals turn its counts into probabilities.
    """

    def sums(ctx: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        """The first of two columns, the sum of the others, for each context."""
        order = np.argsort(ctx)
        first = np.flatnonzero(np.concatenate(([True], np.diff(ctx[order]) != 0))[: len(ctx)])
        return [ctx[order][first], *[c[order][first] for c in columns[:2]], *[np.add.reduceat(c[order], first) if len(first) else c for c in columns[2:]]]

    def known(x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        (ctx, word, n), (total, up) = at_contexts(x, t)
        return [parent_run(up.view(U), word.view(U)), ctx, up, total, n]

    def terms(x: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
        upg, ctx, up, total, n = x
        number, hit = values_at(upg, table)
        if not hit.all():
            raise RuntimeError("a run is listed whose shorter run is not")
        return sums(ctx, up, total, n * np.log(n / number), n, np.ones(len(n), np.int64))

    def whole(x: np.ndarray) -> list[np.ndarray]:
        ctx, up, total, gain, listed, kinds = sums(x[0], x[1], x[2], x[3].view(np.float64), x[4], x[5])
        return [ctx, up, total, gain - listed * np.log(total), listed, kinds]

    mine = dealt(s, list, 0, 3)
    partial = met([met([mine, contexts], [3, 3], known), parents], [5, 2], terms)
    out = met([partial], [6], whole, ["ctx", "up", "total", "gain", "listed", "kinds"], "ctx long, up long, total long, gain double, listed long, kinds long")
    gain = F.col("gain")
    if above is not None:
        out = out.join(above.select(F.col("ctx").alias("up"), F.col("total").alias("whole")).hint("shuffle_hash"), "up")
        gain = gain + F.col("listed") * F.log("whole")
    rest = F.col("total") - F.col("listed")  # each of these is a kind
    return out.select("ctx", "up", "total", rest.alias("rest"), (gain > 0.5 * (F.col("kinds") + rest) * F.log("total")).alias("kept"))


def gains_of(s: DataFrame, kept: DataFrame, parents: DataFrame) -> DataFrame:
    """Packed (run, log10 gain, count) of the kept contexts' listed successors, and as side 1 (run, model probability), of which parents has those a level above."""

    def of_kept(x: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        (ctx, word, n), (free, total, up) = at_contexts(x, k)
        return [parent_run(up.view(U), word.view(U)), longer(ctx.view(U), word.view(U)), n, total, free]

    def gain(x: np.ndarray, table: np.ndarray) -> dict[int, list[np.ndarray]]:
        upg, g, n, total, free = x
        free, (pp, hit) = free.view(np.float64), values_at(upg, table)
        if not hit.all():
            raise RuntimeError("a kept context lists a successor that its suffix does not")
        return {0: [g, np.log10(1 + n / free / pp), n], 1: [g, (n + free * pp) / (total + PULL)]}

    some = dealt(kept, lambda b: [column(b, "ctx"), b.column("rest").to_numpy() + PULL, column(b, "total"), column(b, "up")], 1)
    return met([met([dealt(s, list, 0, 3), some], [3, 4], of_kept), parents], [5, 2], gain)


def as_contexts(x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    """(run, count, up) of listed runs as contexts, from (ctx, word, n) and (ctx, up)."""
    (ctx, word, n), (up,) = at_contexts(x, t)
    return [longer(ctx.view(U), word.view(U)), n, longer(up.view(U), word.view(U))]


#: A part of the tree: rows, packed ones with so many columns, and what gives their (key, v, n).
Entries = tuple[DataFrame, int, Callable[..., list[np.ndarray]]]


def learn_tree(docs: DataFrame, words: DataFrame, p_of: Callable[[np.ndarray], np.ndarray], n_all: int) -> list[Entries]:
    """log10 back-off weights (v) of kept contexts and log10 gains of their listed successors, seen n times.

    words: packed (key, n); p_of: the root's probability of a word seen so
    often. A run's count is its total as a context, and its successors seen once
    are what the listed ones leave of it. Contexts of one word are counted in
    one pass over the texts, longer ones together in another.
    """
    spark = docs.sparkSession

    def root_of(x: np.ndarray) -> list[np.ndarray]:
        x = often(x, SUCCESSOR_MIN)
        return [first_key(x), p_of(x[1])]

    levels: list[tuple[DataFrame, DataFrame]] = []
    contexts, width, key, parents = words, 2, first_key, dealt(words, root_of, 1, 2)
    counted: list[DataFrame] = []
    for d in range(1, DEPTH + 1):
        if d <= 2:
            # 1 / HOT_CONTEXT rows at most
            hot = gathered(contexts, lambda x, key=key: [key(often(x, max(CONTEXT_MIN, HOT_CONTEXT * n_all)))], width, 1)[0].view(U)
            depths = (1,) if d == 1 else tuple(range(2, DEPTH + 1))
            # a longer pair that occurs twice ends in one that does; those are the listed ones of contexts of one word
            twice = None if d == 1 else bit_filter(counted[0], run_key, 3)
            frequent = bit_filter(contexts, lambda x, key=key: key(often(x)), width)
            counted.append(written(level_counts(docs, depths, frequent, np.sort(hot), twice), "successors"))
            release(spark)
        s = counted[-1].filter(F.col("side") == d)
        if d == 1:
            known = dealt(words, lambda x: [first_key(often(x)), often(x)[1], np.zeros(often(x).shape[1], np.int64)], 1, 2)
        elif d == 2:
            known = dealt(contexts, lambda x: [run_key(often(x)), often(x)[2], mixed(often(x)[1].view(U))], 1, 3)
        else:  # the suffix of a context is its own context's suffix with the same last word
            shorter = dealt(levels[-1][0].select("ctx", "up"), lambda b: [column(b, "ctx"), column(b, "up")], 1)
            known = met([dealt(contexts, lambda x: list(often(x)), 0, 3), shorter], [3, 2], as_contexts, side=1)
        levels.append((written(tested_contexts(s, parents, known, levels[-1][0] if levels else None), "contexts"), s))
        contexts, width, key = s, 3, run_key
        parents = dealt(s, lambda x: [run_key(x), x[2].astype(np.float64)], 1, 3)
        release(spark)
    kept: list[DataFrame] = []
    for d in range(DEPTH - 1, -1, -1):  # suffixes of kept contexts are kept
        k = levels[d][0]
        if kept:
            below = kept[0].select(F.col("up").alias("ctx")).distinct().withColumn("suffix", F.lit(True))
            k = k.join(below.hint("shuffle_hash"), "ctx", "left").withColumn("kept", F.col("kept") | F.coalesce("suffix", F.lit(False)))
        kept.insert(0, written(k.filter("kept").select("ctx", "up", "total", "rest"), "kept"))
    discard(*[k for k, _ in levels])

    def weights(b: pa.RecordBatch) -> list[np.ndarray]:
        total, rest = b.column("total").to_numpy(), b.column("rest").to_numpy()
        return [weight_key(column(b, "ctx")), np.log10((rest + PULL) / (total + PULL)), total]

    out: list[Entries] = []
    made: list[DataFrame] = []
    parents = dealt(words, root_of, 1, 2)
    for k, (_, s) in zip(kept, levels, strict=True):
        made.append(written(gains_of(s, k, parents), "gains", by="side"))
        if len(made) > 1:
            discard_part(made[-2], "side", 1)
        release(spark)
        parents = made[-1].filter("side = 1")
        out.append((k.select("ctx", "total", "rest"), 0, weights))
        out.append((made[-1].filter("side = 0"), 3, list))
    discard_part(made[-1], "side", 1)
    discard(*counted)
    return out


class Lookup:
    """The common entries of a tree in whole, and a filter of all."""

    def __init__(self, tree: list[Entries], least: float):
        keys: list[np.ndarray] = [np.zeros(0, U)]
        values: list[np.ndarray] = [np.zeros(0)]
        self.bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for rows, width, columns in tree:  # at most 2 DEPTH / HOT_SHARE rows in all
            if width:
                key, v, _ = gathered(rows, lambda x: list(often(x, least)), width, 3)
            else:
                some = [as_longs(columns(b)) for b in rows.filter(F.col("total") >= least).toArrow().to_batches() if b.num_rows]
                key, v, _ = np.concatenate(some or [np.zeros((3, 0), np.int64)], axis=1)
            keys.append(key.view(U))
            values.append(v.view(np.float64))
            self.bits |= bit_filter(rows, lambda x, columns=columns: columns(x)[0].view(U), width)
        order = np.argsort(np.concatenate(keys))
        self.keys, self.values = np.concatenate(keys)[order], np.concatenate(values)[order]

    def scores(self, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per position the sum of common entries; positions and keys of those to be met in the table."""
        total = np.zeros(len(h))
        places: list[np.ndarray] = [np.zeros(0, np.int64)]
        keys: list[np.ndarray] = [np.zeros(0, U)]

        def add(use: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Positions whose key may have an entry."""
            some = may_hold(self.bits, key)
            use, key = use[some], key[some]
            at, hit = found_in(self.keys, key)
            if len(self.keys):
                total[use[hit]] += self.values[at[hit]]
            places.append(use[~hit])
            keys.append(key[~hit])
            return use

        kept = np.flatnonzero(start < np.arange(len(h)))
        listed = np.ones(len(h), bool)
        last = None
        for g, long in run_hashes(h, start, DEPTH + 1):
            if last is not None:
                # no entry where the context or run one word shorter has none
                kept = kept[long[kept]]
                kept = add(kept, weight_key(before(last)[kept]))
                more = kept[listed[kept]]
                more = add(more, g[more])
                listed[:] = False
                listed[more] = True
            last = g
        return total, np.concatenate(places), np.concatenate(keys)


#: Lookups carry 48 bits of their keys; the bucket, which follows from all 64, tells apart what they leave.
#: A document of a run, and what the tables add to it.
DOC = np.dtype([("id", "<i8"), ("null", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
PART = np.dtype([("doc", "<u4"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])
#: Kinds of rows: an entry of the tree, a word's count, lookups in the tree, lookups of words, documents.
ENTRY, COUNT, ASK_TREE, ASK_WORDS, DOCS = range(5)
DEALT = "bucket int, kind int, chunk long, keys binary, docs binary"
DEALT_NAMES = ["bucket", "kind", "chunk", "keys", "docs"]


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learn.alias("_learn"))
    train = d.filter("_learn").select("text")
    words = written(token_counts(train), "words")
    release(spark)
    n_all, v_all, once, twice = gathered(words, lambda x: [np.array([f]) for f in (x[1].sum(), x.shape[1], (x[1] == 1).sum(), (x[1] == 2).sum())], 2, 4).sum(axis=1).tolist()  # a column a task's bucket
    floor = n_all + 0.1 * (v_all + 1)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    unknown = discount * v_all / n_all if n_all else 1.0
    least = max(1.0, BROADCAST_SHARE * n_all)

    tree = learn_tree(train, words, lambda n: (n - discount) / max(n_all, 1), n_all)
    release(spark)
    held = Lookup(tree, HOT_SHARE * n_all)
    key, n = gathered(words, lambda x: list(often(x, least)), 2, 2)  # at most 1 / BROADCAST_SHARE rows
    order = np.argsort(key.view(U))
    release(spark)
    model = spark.sparkContext.broadcast((held, key.view(U)[order], n[order]))
    n_parts, n_buckets = partitions(spark), buckets(docs)

    def by_count(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The base score of a token seen c times, and its score at the root."""
        own = np.log10(np.where(c > 0, c - discount, 1.0) / max(n_all, 1))
        return np.log10((c + 0.1) / floor), np.where(c > 0, own, math.log10(unknown))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, common, counts = model.value
        task, chunk = TaskContext.get().partitionId(), 0
        for b in batches:
            for s, e, w in word_runs(b.column("text"), SCORE_RUN):
                n = e - s
                keys = np.append(w.keys(), END_KEY)
                h, start = w.tokens(keys)
                first = np.unique(start)
                total, place, tree_keys = held.scores(h, start)
                doc_of = np.repeat(np.arange(n), w.count + 2)
                token_doc = np.concatenate((np.repeat(np.arange(n), w.count), np.arange(n)))
                token = np.concatenate((w.which, np.full(n, len(keys) - 1)))
                at, hit = found_in(common, keys)
                base, own = by_count(np.where(hit, counts[at], 0) if len(counts) else np.zeros(len(keys)))
                docs_ = np.zeros(n, DOC)
                ids = b.column("doc_id")[s:e]
                docs_["id"], docs_["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                docs_["tokens"] = w.count + 1
                known = hit[token]
                docs_["known"] = np.bincount(token_doc[known], minlength=n)
                docs_["base"] = np.bincount(token_doc[known], base[token[known]], n)
                docs_["score"] = np.add.reduceat(total, first) + np.bincount(token_doc[known], own[token[known]], n)
                rows = [((task + chunk) % n_buckets, DOCS, b"", docs_.tobytes())]
                for kind, k, doc in ((ASK_TREE, tree_keys, doc_of[place]), (ASK_WORDS, keys[token[~known]], token_doc[~known])):
                    deal = bucket_of(k, n_buckets)
                    order = np.argsort(deal * n + doc)
                    k, doc, deal = k[order], doc[order].astype(np.uint32), deal[order]
                    rows += [(int(deal[x]), kind, narrow(k[x:y]), doc[x:y].tobytes()) for x, y in slices(deal)]
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(np.full(m, (task << 32) + chunk)),
                     pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=DEALT_NAMES,
                )
                chunk += 1

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tables, ready = None, ([], [], [], []), None
        for b in batches:
            columns = [b.column(c) for c in ("bucket", "kind")]
            both = columns[0].to_numpy().astype(np.int64) * 8 + columns[1].to_numpy()
            out = []
            for s, e in slices(both):
                k, kind = int(both[s] >> 3), int(both[s] & 7)
                if k != bucket:
                    bucket, tables, ready = k, ([], [], [], []), None
                if kind <= COUNT:
                    for packed in b.column("docs")[s:e].to_pylist():
                        key, v = np.frombuffer(packed, np.int64).reshape(2, -1)
                        tables[2 * kind].append(key.view(U) & LOW48)
                        tables[2 * kind + 1].append(v.view(np.float64))
                    continue
                if ready is None:
                    ready = []
                    for i in (0, 2):
                        key = np.concatenate(tables[i] or [np.zeros(0, U)])
                        order = np.argsort(key)
                        ready += [key[order], np.concatenate(tables[i + 1] or [np.zeros(0)])[order]]
                for chunk, keys, docs_ in zip(*(b.column(c)[s:e].to_pylist() for c in ("chunk", "keys", "docs")), strict=True):
                    if kind == DOCS:
                        out.append((chunk, 0, docs_))
                        continue
                    doc, keys = np.frombuffer(docs_, np.uint32), widened(keys)
                    at, hit = found_in(ready[0 if kind == ASK_TREE else 2], keys)
                    if kind == ASK_TREE:
                        doc, at = doc[hit], at[hit]
                    if not len(doc):
                        continue
                    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    part = np.zeros(len(cut), PART)
                    part["doc"] = doc[cut]
                    if kind == ASK_TREE:
                        part["score"] = np.add.reduceat(ready[1][at], cut)
                    else:
                        base, own = by_count(np.where(hit, ready[3][at], 0) if len(ready[3]) else np.zeros(len(doc)))
                        part["known"] = np.add.reduceat(hit.astype(np.uint32), cut)
                        part["base"], part["score"] = np.add.reduceat(base, cut), np.add.reduceat(own, cut)
                    out.append((chunk, 1, part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["chunk", "kind", "rows"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_ = None
        for b in batches:
            for _, kind, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    if docs_ is not None:
                        yield finished(docs_)
                    docs_ = np.frombuffer(rows, DOC).copy()
                else:
                    part = np.frombuffer(rows, PART)
                    for c in ("known", "base", "score"):
                        docs_[c][part["doc"]] += part[c]
        if docs_ is not None:
            yield finished(docs_)

    def finished(x: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(x["id"]), mask=x["null"].copy()), *[pa.array(np.ascontiguousarray(x[c])) for c in ("tokens", "known", "base", "score")]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    hot = HOT_SHARE * n_all
    tables = dealt(words, lambda x: [x[0][x[1] < least], x[1][x[1] < least].astype(np.float64)], COUNT, 2)
    for some, width, columns in tree:

        def cold(x, columns=columns) -> list[np.ndarray]:
            key, v, n = columns(x)
            return [key[n < hot], v[n < hot]]

        tables = tables.unionAll(dealt(some, cold, ENTRY, width))
    tables = tables.select("bucket", "side", F.lit(None).cast("long"), F.lit(None).cast("binary"), "rows")
    rows = d.select("doc_id", "text").mapInArrow(asked, DEALT).unionAll(tables)
    met = rows.repartitionById(n_parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answered, "chunk long, kind int, rows binary")
    scored = met.repartition(n_parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
