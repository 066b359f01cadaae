"""SimHash fingerprints and near-duplicate components through BK-trees.

A fingerprint bit is set if it is set in over half of a text's shingle hashes
(repeats count). Equal fingerprints are one node from the start. Two nodes
link at `radius` or fewer differing bits.

Search: the 64 bits are cut into five blocks; fingerprints at most three bits
apart agree in at least two of them, so each of the ten pairs of blocks is a
shard key and any linked pair meets in some shard. A shard is a BK-tree
(children keyed by their integer Hamming distance to the parent), and a lookup
follows only edges within the radius of the query's distance. A tree is built
where its rows were shuffled to instead of being broadcast: all trees together
are as large as the data, so no broadcast of them would have a bound.

A shard yields, for every node that has a neighbour, one edge to the root of
its union-find set: as many rows as it has nodes, never all its pairs. Shards
that a few near-identical texts crowd are cut again: the bits that the key
leaves free are split into finer blocks, by the same pigeonhole rule, until a
part is small. Components come from label propagation over these edges.

Defined results: null and blank texts have fingerprint zero and link like any
other; rows with a null id have a fingerprint and can join two components, but
never give a component its name (a component of such rows alone has null);
repeated rows stay; an empty table gives an empty result; further columns are
kept by `near_duplicates`, where clashing names are overwritten.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written

#: Hash seed, and the five blocks of the 64 bits as (shift, width).
SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
#: Nodes above which a shard is cut once more before trees are built.
SHARD_NODES = 2048

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
STEP = 1 << 15


def words_of(text: str) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    w = words_of(text)
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        hashes = [digest(b" ".join(w), SEED)]
    else:
        grams = w
        for k in range(1, shingle):
            grams = [a + b" " + b for a, b in zip(grams, w[k:], strict=False)]
        hashes = [digest(g, SEED) for g in grams]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        h = np.array(hashes[at : at + STEP], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    over = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(over).view(">i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The input's columns but the text, and `fp`."""
    keep = [c for c in docs.columns if c not in (text_col, "fp")]
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = d.drop("_text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(fp, pa.int64())], names=[*keep, "fp"])

    return d.mapInArrow(run, schema)


class BKTree:
    """Children keyed by distance to the parent; looking up a batch follows all its frontiers at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.children: list[dict[int, int]] = [{} for _ in keys]
        whole = keys.tolist()
        for i in range(1, len(whole)):
            at, x = 0, whole[i]
            while True:
                d = (whole[at] ^ x).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = i
                    break
                at = nxt
        edges = [(p, d, c) for p, kids in enumerate(self.children) for d, c in kids.items()]
        e = np.array(edges, np.int64).reshape(-1, 3)
        self.dist, self.child = e[:, 1], e[:, 2]
        self.first = np.searchsorted(e[:, 0], np.arange(len(whole) + 1))

    def links(self, radius: int, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in blocks of queries with at most `most` pairs at a time; each pair once, query the larger index."""
        n = len(self.keys)
        step = max(1, most // max(1, n))
        for lo in range(0, n, step):
            q = np.arange(lo, min(lo + step, n))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(self.keys[q] ^ self.keys[node]).astype(np.int64)
                near = (d <= radius) & (node < q)
                if near.any():
                    yield q[near], node[near]
                kids = self.first[node + 1] - self.first[node]
                rep = np.repeat(np.arange(len(q)), kids)
                if not len(rep):
                    break
                slot = np.arange(len(rep)) - np.repeat(np.cumsum(kids) - kids, kids) + np.repeat(self.first[node], kids)
                ok = (np.abs(self.dist[slot] - d[rep]) <= radius) & (self.child[slot] <= q[rep])
                q, node = q[rep[ok]], self.child[slot[ok]]


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the pairs' sets: the roots take the smaller root's index until nothing changes."""
    while len(a):
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def shard_edges(fps: np.ndarray, radius: int, free: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root fingerprint) of the linked nodes of one shard; fps are distinct."""
    parent = np.arange(len(fps))

    def within(idx: np.ndarray, bits: list[tuple[int, int]]) -> None:
        if len(idx) > SHARD_NODES and len(bits) > radius + 1:
            # pairs at most `radius` bits apart agree in at least one of radius + 1 groups of the free blocks
            for g in range(radius + 1):
                mine = [x for i, x in enumerate(bits) if i % (radius + 1) == g]
                rest = [x for i, x in enumerate(bits) if i % (radius + 1) != g]
                key = np.zeros(len(idx), np.uint64)
                for shift, width in mine:
                    key = (key << np.uint64(width)) | ((fps[idx] >> np.uint64(shift)) & np.uint64((1 << width) - 1))
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                for part in np.split(idx[order], cuts):
                    if len(part) > 1:
                        within(part, rest if len(part) < len(idx) else [])
            return
        tree = BKTree(fps[idx])
        for a, b in tree.links(radius):
            union(parent, idx[a], idx[b])

    within(np.arange(len(fps)), free or [])
    while (parent[parent] != parent).any():
        parent = parent[parent]
    linked = np.bincount(parent, minlength=len(fps))[parent] > 1
    return fps[linked], fps[parent[linked]]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints (column fp) linked within the radius.

    Shard keys serve a radius up to three. Shards are whole groups of the
    shuffle; a task reads its sorted rows as a stream and holds one shard.
    """
    if radius > 3:
        raise ValueError("five blocks serve a radius of three at most")
    keys = []
    for n, (x, y) in enumerate(itertools.combinations(range(5), 2)):
        part = lambda k: F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND((1 << BLOCKS[k][1]) - 1)
        keys.append((part(x) * (1 << 13) + part(y)) * 16 + n)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "k").sortWithinPartitions("k")
    pairs = list(itertools.combinations(range(5), 2))

    def finer(k: int) -> list[tuple[int, int]]:
        """The bits that the key of a shard leaves free, in blocks of three."""
        return [(s + i, min(3, w - i)) for b, (s, w) in enumerate(BLOCKS) if b not in pairs[k % 16] for i in range(0, w, 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held = None, []

        def close() -> tuple:
            f = np.concatenate(held)
            return shard_edges(f, radius, finer(held_k)) if len(f) > 1 else (f[:0], f[:0])

        for b in batches:
            k, f = b.column("k").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            if not len(k):
                continue
            out: list[tuple] = []
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(k)]))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held_k != k[s]:
                    if held:
                        out.append(close())
                    held_k, held = int(k[s]), []
                held.append(f[s:e].copy())
            yield batch(out)
        if held:
            yield batch([close()])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        a = np.concatenate([x[0] for x in out] or [np.zeros(0, np.uint64)]).view(np.int64)
        b = np.concatenate([x[1] for x in out] or [np.zeros(0, np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def components(fp_rows: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id): per distinct fingerprint the smallest id reachable."""
    groups = written(fp_rows.groupBy("fp").agg(F.min(id_col).alias("least")), "fp")
    roots = connected_components(fingerprint_links(groups.select("fp"), radius), "a", "b")
    g = groups.join(roots.hint("shuffle_hash"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = g.groupBy("root").agg(F.min("least").alias("component_id"))
    return g.join(least.hint("shuffle_hash"), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The input's columns but the text, with fingerprint (hex) and component_id."""
    keep = [c for c in docs.columns if c not in (text_col, "fp", "fingerprint", "component_id")]
    fp = written(fingerprints(docs.select(*keep, text_col), text_col, shingle), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fp.join(components(fp, id_col, radius).hint("shuffle_hash"), "fp").select(*keep, hexed, "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs)
