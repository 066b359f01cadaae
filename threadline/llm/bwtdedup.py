"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if some string of `length` bytes that covers it also starts
earlier (in a document with a smaller id, or earlier in the same one).

1. Candidates. Every window of `length` bytes is named by its least K-byte
   hash, the leftmost of equal ones. Consecutive windows with one such place
   form a superwindow; equal windows lie in superwindows of one hash. A
   superwindow that equals an earlier one is repeated as a whole, and one whose
   hash occurs in no different superwindow is done; most text ends here.
2. Merge. Superwindows that share their hash and differ go to shards. Each
   shard sorts its suffixes and keeps its Burrows-Wheeler transform, in steps of
   four symbols. The transforms are merged by refining their interleave: walk it,
   deal the shards' entries stably by the preceding symbols, repeat; after t
   rounds it is ordered by the first 4 t symbols, and a border between suffixes
   that first shows in round t gives their common prefix. No merged suffix is
   compared or sorted again. Stretches without a border up to `length` are the
   repeated intervals; all but the first string of each is repeated.
3. Removal. Repeated stretches are gathered per document and cut out.

Groups above GROUP_ROWS rows or GROUP_BYTES bytes are not handed to one task:
their windows become rows that are counted by hash, which needs no group in
one place. That path gives the same result.

Defined results: null texts are empty; null ids sort first; rows of one id
with different texts are documents of their own, in the order of their texts'
hashes; repeated rows (same id and text) are one document and get equal
results; texts under `length` bytes stay; an empty table gives no rows.
Further columns are kept by `cleaned`, where clashing names are overwritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import give_back
from .common import partitions, table, written

LENGTH, K = 100, 48
PIECE = 1 << 18
GROUP_ROWS, GROUP_BYTES, BATCH_BYTES = 8192, 4 << 20, 1 << 19
SHARDS, STEPS = 4, (10, 4, 1)
NULL_ID = -(1 << 63)
U = np.uint64


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings, put together from strings of powers of two."""
    cur = (b.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    cur ^= cur >> U(29)
    n, size, out, have = len(b), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, have = cur, size
            else:
                m = n - have - size + 1
                out = out[:m] * U(0x94D049BB133111EB) + cur[have : have + m]
                out ^= out >> U(32)
                have += size
        if 2 * size > k:
            break
        m = len(cur) - size
        nxt = cur[:m] * U(0xBF58476D1CE4E5B9) + cur[size : size + m]
        nxt ^= nxt >> U(31)
        cur, size = nxt, 2 * size
    out = out * U(0xD6E8FEB86659FD93)
    return out ^ (out >> U(32))


def superwindows(buf: bytes, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of texts end to end in buf; no window crosses an end."""
    b = np.frombuffer(buf, np.uint8)
    g = gram_hashes(b, k)
    w = length - k + 1
    place = np.arange(len(g), dtype=U)
    least = (g & ~U((1 << 20) - 1)) | place
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    n = len(b) - length + 1
    least = np.minimum(least[:n], least[w - span : w - span + n])
    at = (least & U((1 << 20) - 1)).astype(np.int64)
    text_end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))[:n]
    good = np.arange(n) + length <= text_end
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (text_end[1:] != text_end[:-1])
    new |= ~good
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [n])))
    keep = good[first]
    first, size = first[keep], size[keep]
    return g[at[first]], first, size


def candidate_rows(doc: list[int], ver: list[int], texts: list[bytes], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Superwindows of a batch of texts; those that equal another of the batch are marked (n < 0), all but the first."""
    cols: tuple[list, ...] = ([], [], [], [], [], [])

    def flush() -> Iterator[pa.RecordBatch]:
        if not cols[0]:
            return
        mh, sh, d, v, s, n = (np.concatenate(c) for c in cols)
        both = mh * U(0x9E3779B97F4A7C15) ^ sh
        order = np.lexsort((s, v, d, both))
        again = np.zeros(len(mh), bool)
        x = both[order]
        same = x[1:] == x[:-1]
        # rows of one place (repeated rows of the input) are one row
        twice = same & (d[order][1:] == d[order][:-1]) & (v[order][1:] == v[order][:-1]) & (s[order][1:] == s[order][:-1])
        again[order[1:]] = same
        drop = np.zeros(len(mh), bool)
        drop[order[1:]] = twice
        mh = np.where(again, both + s.astype(U) * U(0xD6E8FEB86659FD93) + d.astype(U), mh)
        sh, n = np.where(again, U(0), sh), np.where(again, -n, n)
        keep = ~drop
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (mh.view(np.int64), sh.view(np.int64), d, v, (s << 32) | (n & 0xFFFFFFFF))], names=["mh", "sh", "doc", "ver", "sn"])
        for c in cols:
            c.clear()

    def take(parts: list[tuple[int, int, int, bytes]]) -> None:
        buf = b"".join(p[3] for p in parts)
        lens = np.array([len(p[3]) for p in parts])
        ends = np.cumsum(lens)
        mh, first, size = superwindows(buf, ends, length, k)
        if not len(mh):
            return
        owner = np.searchsorted(ends, first, side="right")
        digest = xxhash.xxh3_64_intdigest
        view = memoryview(buf)
        sh = np.array([digest(view[a:e]) for a, e in zip(first.tolist(), (first + size + length - 1).tolist(), strict=True)], U)
        info = np.array([(p[0], p[1], p[2]) for p in parts], np.int64)
        begin = ends - lens
        for c, x in zip(cols, (mh, sh, info[owner, 0], info[owner, 1], info[owner, 2] + first - begin[owner], size), strict=True):
            c.append(x)

    parts: list[tuple[int, int, int, bytes]] = []
    held = rows = 0
    for d, v, t in zip(doc, ver, texts, strict=True):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            piece = t[at : at + PIECE + length - 1]
            if len(piece) < length:
                continue
            parts.append((d, v, at, piece))
            held += len(piece)
            if held >= PIECE:
                take(parts)
                parts, held = [], 0
                rows = sum(map(len, cols[0]))
                if rows > 600_000:
                    yield from flush()
    if parts:
        take(parts)
    yield from flush()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ver, text): ver is 0 where ids are unique, else the text's hash; nothing is null."""
    ids = docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    # a zero that is no literal: with a literal the two joins of the texts would not share one exchange
    return docs.select("*", doc.alias("_doc"), (F.xxhash64(text) if ids else doc.bitwiseAND(F.lit(0))).alias("_ver"), text.alias("_body"))


SCAN = "kind int, mh long, doc long, ver long, start long, n long"


def scan_groups(rows: DataFrame, length: int) -> DataFrame:
    """kind 0: repeated stretches (n bytes); kind 1: superwindows (n windows) whose hash has others that differ.

    Rows arrive sorted by hash, text and place, and stream through; what a task
    holds is one row of the group at hand.
    """
    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "mh").sortWithinPartitions("mh", "sh", "doc", "ver", "sn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # mh, sh and place of the first row of the last (mh, sh)
        held = None  # the group's first row, if nothing else of the group was seen yet
        for b in batches:
            mh, sh, doc, ver, sn = (b.column(i).to_numpy() for i in range(5))
            start, size = sn >> 32, (sn & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
            marked = size < 0
            out = [(np.zeros(marked.sum(), np.int32), mh[marked], doc[marked], ver[marked], start[marked], -size[marked] + length - 1)]
            keep = ~marked
            mh, sh, doc, ver, start, size = (x[keep] for x in (mh, sh, doc, ver, start, size))
            m = len(mh)
            if m:
                new_g, new_s = np.ones(m, bool), np.ones(m, bool)
                new_g[1:] = mh[1:] != mh[:-1]
                new_s[1:] = new_g[1:] | (sh[1:] != sh[:-1])
                if last is not None:
                    new_g[0] = mh[0] != last[0]
                    new_s[0] = new_g[0] or sh[0] != last[1]
                # repeated superwindows: not the first of their text, nor another row of the first's place
                first = np.maximum.accumulate(np.where(new_s, np.arange(m), -1))
                f = np.maximum(first, 0)
                fd, fv, fs = (np.where(first >= 0, x[f], 0 if last is None else y) for x, y in ((doc, last and last[2]), (ver, last and last[3]), (start, last and last[4])))
                rep = ~new_s & ((doc != fd) | (ver != fv) | (start != fs))
                out.append((np.zeros(rep.sum(), np.int32), mh[rep], doc[rep], ver[rep], start[rep], size[rep] + length - 1))
                # differing ones: any in a group with two texts or more
                g = np.cumsum(new_g) - new_g[0]
                texts = np.bincount(g, new_s, g[-1] + 1)
                if not new_g[0]:
                    if new_s[g == 0].any():
                        if held is not None:
                            out.append(tuple(np.array([x]) for x in (np.int32(1), *held)))
                            held = None
                        texts[0] = 2
                    else:
                        texts[0] = 0
                if new_g.any():
                    held = None
                many = new_s & (texts[g] >= 2)
                out.append((np.ones(many.sum(), np.int32), mh[many], doc[many], ver[many], start[many], size[many]))
                i = int(first[-1])
                if i >= 0:
                    last = (int(mh[i]), int(sh[i]), int(doc[i]), int(ver[i]), int(start[i]))
                    if texts[g[-1]] == 1 and new_g.any():
                        held = (mh[i], doc[i], ver[i], start[i], size[i])
            cols = [np.concatenate([o[j] for o in out]) for j in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if j == 0 else np.int64)) for j, c in enumerate(cols)], names=["kind", "mh", "doc", "ver", "start", "n"])
        give_back()

    return dealt.mapInArrow(run, SCAN)


def dense(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones, in half of what np.unique takes."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    rank = np.zeros(len(x), np.int32)
    np.cumsum(x[1:] != x[:-1], dtype=np.int32, out=rank[1:])
    del x
    out = np.empty(len(rank), np.int32)
    out[order] = rank
    return out


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of small non-negative integers by 16-bit digits."""
    if not len(x) or x.max() < 1 << 16:
        return np.argsort(x.astype(np.uint16), kind="stable")
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((x[low] >> 16).astype(np.uint16), kind="stable")]


def merge_shards(texts: list[bytes], shard: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of all suffixes, ordered by their first `depth` symbols, so many a round as the first of STEPS that divides it.

    Returns text number and offset per suffix in merged order, the common prefix
    with the one before in whole steps (depth where they agree that far), and
    each suffix's length. `shard` gives the shard of each text.
    """
    q = next(x for x in STEPS if depth % x == 0)
    lens = np.array([len(t) for t in texts])
    gap = lens + q
    begin = np.concatenate(([0], np.cumsum(gap)[:-1])).astype(np.int32)  # a batch is far below 2 GB
    sym = np.zeros(int(gap.sum()) + q, np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    off = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(lens) - lens).astype(np.int32), lens)
    pos = begin[owner] + off
    sym[pos] = np.frombuffer(b"".join(texts), np.uint8)
    sym[pos] += 1
    # q symbols as one number: of half of them, then of two such
    half = (q + 1) // 2
    packed = sym[:-half]
    for i in range(1, half):
        packed = packed * 257 + sym[i : len(sym) - half + i]
    part = np.zeros(len(sym), np.int32)
    size = len(sym) - q
    del sym
    packed = packed[pos]
    part[pos] = dense(packed) + 1  # 0: past the end
    del packed
    gram = np.zeros(size, np.int32)
    if half < q:
        key = part[pos].astype(np.int64)
        key *= len(part) + 1
        key += part[pos + half]
        gram[pos] = dense(key) + 1
        del key
    else:
        gram[pos] = part[pos]
    del part
    # every shard sorts its own suffixes by doubling
    order = []
    for s in range(int(shard.max()) + 1):
        mine = np.flatnonzero(shard[owner] == s)
        p = pos[mine]
        e = begin[owner[mine]] + lens[owner[mine]].astype(np.int32)
        rank = np.zeros(len(gram), np.int32)
        rank[p] = gram[p]
        h = q
        while h < depth and len(p):
            nxt = p + h
            key = rank[p].astype(np.int64) * (len(gram) + 1) + np.where(nxt < e, rank[np.minimum(nxt, len(gram) - 1)], 0)
            rank[p] = dense(key) + 1
            h *= 2
        order.append(mine[np.argsort(rank[p], kind="stable")])
    local = np.concatenate(order)
    # the transform: the q symbols before a suffix, -1 where its text starts
    before = np.where(off[local] >= q, gram[np.maximum(pos[local] - q, 0)], np.int32(-1))
    z = np.repeat(np.arange(len(order), dtype=np.uint8), [len(o) for o in order])
    n = len(local)
    short = local[lens[owner[local]] - off[local] <= q]  # suffixes that no other suffix follows
    short_gram, short_shard = gram[pos[short]], shard[owner[short]].astype(np.uint8)
    block = np.zeros(n, np.int32)
    common = np.full(n, depth, np.int32)
    common[:1] = 0
    at, turn = np.empty(n, np.int32), np.arange(n, dtype=np.int32)

    def places(z: np.ndarray) -> np.ndarray:
        at[np.argsort(z, kind="stable")] = turn  # a shard's suffixes stay in their order
        return at

    for t in range(depth // q):
        x = before[places(z)]
        has = x >= 0
        syms = np.concatenate((short_gram, x[has]))
        # what follows a short suffix is nothing: equal to all before the first round, to none after it
        blocks = np.concatenate((-1 - np.arange(len(short_gram), dtype=np.int32) if t else np.zeros(len(short_gram), np.int32), block[has]))
        by = stable_order(syms)
        z = np.concatenate((short_shard, z[has]))[by]
        syms, blocks = syms[by], blocks[by]
        border = np.ones(n, bool)
        border[1:] = (syms[1:] != syms[:-1]) | (blocks[1:] != blocks[:-1])
        common[border & (common == depth)] = q * t
        block = np.cumsum(border, dtype=np.int32)
    item = local[places(z)]
    return owner[item], off[item], common, lens[owner[item]] - off[item]


def repeated_windows(texts: list[bytes], doc: np.ndarray, ver: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(doc, ver, start, bytes) of the stretches of superwindows that occur earlier in another of them."""
    shard = np.arange(len(texts)) % min(SHARDS, len(texts))
    who, off, common, left = merge_shards(texts, shard, length)
    interval = np.cumsum(common < length)
    whole = left >= length
    who, off, interval = who[whole], off[whole], interval[whole]
    many = np.bincount(interval)[interval] > 1
    who, off, interval = who[many], off[many], interval[many]
    at = start[who] + off
    order = np.lexsort((at, ver[who], doc[who], interval))
    who, off, interval, at = who[order], off[order], interval[order], at[order]
    head = np.ones(len(who), bool)
    head[1:] = interval[1:] != interval[:-1]
    f = np.maximum.accumulate(np.where(head, np.arange(len(who)), 0))
    later = (doc[who] != doc[who[f]]) | (ver[who] != ver[who[f]]) | (at != at[f])
    who, off = who[later], off[later]
    order = np.lexsort((off, who))
    who, off = who[order], off[order]
    if not len(who):
        return []
    cut = np.concatenate(([0], np.flatnonzero((np.diff(who) != 0) | (np.diff(off) != 1)) + 1, [len(who)]))
    a, e = cut[:-1], cut[1:] - 1
    w = who[a]
    return list(zip(doc[w].tolist(), ver[w].tolist(), (start[w] + off[a]).tolist(), (off[e] - off[a] + length).tolist(), strict=True))


SPAN = "doc long, ver long, start long, n long"
SPAN_NAMES = ["doc", "ver", "start", "n"]


def spans_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=SPAN_NAMES)


def merged_spans(snippets: DataFrame, length: int) -> DataFrame:
    """Repeated stretches from superwindows (mh, doc, ver, start, body): whole groups, a few megabytes at a time."""
    dealt = snippets.repartition(partitions(snippets.sparkSession), "mh").sortWithinPartitions("mh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            _, doc, ver, start, body = zip(*rows, strict=True)
            return spans_batch(repeated_windows(list(body), *(np.array(x, np.int64) for x in (doc, ver, start)), length))

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= BATCH_BYTES and r[0] != last:
                    yield done()
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
                last = r[0]
        if rows:
            yield done()
        rows = []
        give_back()

    return dealt.mapInArrow(run, SPAN)


def with_bodies(docs: DataFrame, wanted: DataFrame, each, schema: str, names: list[str], kinds: list) -> DataFrame:
    """Superwindows with their bytes: wanted (doc, ver, mh, start, n) meets the texts; `each` makes rows of one."""
    per = wanted.groupBy("doc", "ver").agg(F.collect_list(F.struct("mh", "start", "n")).alias("parts"))
    j = docs.select("_doc", "_ver", "_body").join(per.hint("shuffle_hash"), (F.col("_doc") == F.col("doc")) & (F.col("_ver") == F.col("ver")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, v, t, parts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for x in parts:
                    out.extend(each(d, v, raw, x["mh"], x["start"], x["n"]))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)
        out = []
        give_back()

    return j.select("_doc", "_ver", "_body", "parts").mapInArrow(run, schema)


def crowded_spans(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for a task: windows are rows, counted by a 128-bit hash."""

    def each(d, v, raw, mh, start, n):
        for p in range(start, start + n):
            h = xxhash.xxh3_128_intdigest(raw[p : p + length])
            yield (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), d, v, p

    names = ["h1", "h2", "doc", "ver", "start"]
    w = written(with_bodies(docs, wanted, each, "h1 long, h2 long, doc long, ver long, start long", names, [pa.int64()] * 5), "windows")
    place = F.struct("doc", "ver", "start")
    first = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return w.join(first.hint("shuffle_hash"), ["h1", "h2"]).filter(place > F.col("first")).select("doc", "ver", "start", F.lit(length).cast("long").alias("n"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc, ver, start, n): stretches to remove, which may overlap. docs is keyed()."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: list[int] = []
        ver: list[int] = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            for d, v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                doc.append(d)
                ver.append(v)
                texts.append(raw)
                size += len(raw)
                if size > 16 << 20:
                    yield from candidate_rows(doc, ver, texts, length, k)
                    doc, ver, texts, size = [], [], [], 0
        yield from candidate_rows(doc, ver, texts, length, k)
        doc, ver, texts = [], [], []
        give_back()

    rows = docs.select("_doc", "_ver", "_body").mapInArrow(candidates, "mh long, sh long, doc long, ver long, sn long")
    scan = written(scan_groups(rows, length), "scan")
    whole = scan.filter("kind = 0").select(*SPAN_NAMES)
    open_ = scan.filter("kind = 1").select("mh", *SPAN_NAMES)
    sizes = open_.groupBy("mh").agg(F.count("*").alias("rows"), F.sum(F.col("n") + length - 1).alias("bytes"))
    crowded = written(sizes.filter((F.col("rows") > GROUP_ROWS) | (F.col("bytes") > GROUP_BYTES)).select("mh"), "crowded")
    some = crowded.limit(1).count() > 0
    small = open_.join(crowded.hint("shuffle_hash"), "mh", "left_anti") if some else open_

    def each(d, v, raw, mh, start, n):
        yield mh, d, v, start, raw[start : start + n + length - 1]

    snippets = with_bodies(docs, small, each, "mh long, doc long, ver long, start long, body binary", ["mh", *SPAN_NAMES[:3], "body"], [pa.int64()] * 4 + [pa.binary()])
    out = whole.unionAll(merged_spans(snippets, length))
    if some:
        out = out.unionAll(crowded_spans(docs, open_.join(crowded.hint("shuffle_hash"), "mh", "left_semi"), length))
    return out


CUT = T.StructType().add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "string")


@F.arrow_udf(CUT)
def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(texts, spans, strict=True):
        raw = t.as_py().encode("utf-8", "surrogatepass")
        parts, at, removed, runs = [], 0, 0, 0
        reach = -1
        for x in s.as_py() or ():
            a, e = x["start"], x["start"] + x["n"]
            if a > reach:
                parts.append(raw[at:a])
                runs += 1
                at = reach = a
            if e > reach:
                removed += e - reach
                at = reach = e
        parts.append(raw[at:])
        kept = b"".join(parts)
        out.append({"n_removed": removed, "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode("utf-8", "ignore")})
    return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """Documents with `kept` (what is left of the text; a character cut in half goes), n_bytes, n_removed, n_spans, kept_sha256."""
    results = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    keep = [c for c in docs.columns if c != text_col and c not in results]
    alone = keep == [id_col]  # then the id comes back out of the key, and the texts are shuffled once for both joins
    further = [] if alone else [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep")]  # in one column, so that no name clashes
    d = keyed(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *further), "_id", "_text")
    spans = repeated_spans(d, length, k)
    per = spans.groupBy("doc", "ver").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    left = d.select("_doc", "_ver", "_body", *([] if alone else ["_keep"]))
    j = left.join(per.hint("shuffle_hash"), (F.col("_doc") == F.col("doc")) & (F.col("_ver") == F.col("ver")), "left")
    columns = [F.nullif("_doc", F.lit(NULL_ID)).cast(docs.schema[id_col].dataType).alias(id_col)] if alone else [F.col("_keep").getField(c).alias(c) for c in keep]
    return j.withColumn("_c", cut_out("_body", "spans")).select(
        *columns, F.col("_c.kept").alias("kept"), F.octet_length("_body").cast("long").alias("n_bytes"), "_c.n_removed", "_c.n_spans", "_c.kept_sha256"
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
