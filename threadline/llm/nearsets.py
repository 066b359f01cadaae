"""Near copies by the Jaccard similarity of their word shingles, found by wide SimHash.

1. Texts with equal shingle sets are one node. A node has a SimHash of 256 bits
   over its distinct shingles; at similarity s two nodes differ in about
   acos(2 s / (1 + s)) / pi of the bits: 39 at 0.8. Of few shingles the bits do
   not differ independently, so small sets are joined exactly and not by them.
2. Small sets. Two sets with `i` shingles in common reach `least` when they have
   at most D = i (1 - least) / least others together. A set of up to FEW + 2
   shingles stands under the sum of each of its subsets without at most two of
   them. Of the sets under one subset, the one that leaves out the least is
   linked with all that it is near to; two that are near each other are then
   both near it, so a link a row joins all that belong together.
3. Candidates among sets over FEW shingles. Each of many tables picks some of the bits; nodes that agree in
   them meet. Bits a table rise with the number of nodes and tables with them,
   so that at `least` all but MISS of the pairs are expected to meet. A table's
   key is a shard, the shard is a BK-tree, and a node's lookup follows the edges
   within RADIUS of its distance; pairs too different in size go.
4. Verification. The shingle sets of candidates are compared in full.

At first a node of a group is only compared with one node before it that its
fingerprint is near to; what these pairs link is merged, and then the pairs that
still lie across components are compared, so that a large group of copies is not
squared. Where a node of a shard has over CROWD of these, the shard gives no
pairs but the nodes that have any. Such nodes are joined exactly: of two sets
that reach `least` the first shingles, the rarest among these nodes first, have
one in common. Texts made from one by different changes differ in just those, so
a large group that is near `least` but under it is not squared either.

Defined results: a null text is an empty one, and those are one node; a text of
fewer words than a shingle has is one shingle; equal texts are one node; ties do
not matter, as links have no direction; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import give_back
from .common import connected_components, discard, partitions, release, written
from .simhash import SEED, STEP, words_of

WORDS, RADIUS, MISS = 4, 62, 0.005
#: Nodes of a small shard; a step of lookups makes at most as many visits as 16,384 queries in such shards.
SMALL = 64
#: Nodes across components that a node may be near to in a shard.
CROWD = 8
FEW = 11  # at 0.8, sets with up to so many shingles in common differ in two at most
NODE = ["sk", "f0", "f1", "f2", "f3", "size"]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted; of a shorter text the whole."""
    w = words_of(text or "")
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


def wide(h: np.ndarray) -> list[int]:
    """The fingerprint as signed 64-bit integers."""
    out = []
    for i in range(1, WORDS + 1):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), STEP):
            x = h[at : at + STEP] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 0x5851F42D4C957F2D & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            x = x ^ (x >> np.uint64(32))
            ones += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits((2 * ones > len(h)).astype(np.uint8)).view(">i8")[0]))
    return out


def with_sets(docs: DataFrame, key: str, shingle: int) -> DataFrame:
    """(key, sk, f0 .. f3, size, sh) of (key, text): node, fingerprint, and the set in 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                sets = [shingles(t, shingle) for t in part.column(1).to_pylist()]
                sk = pa.array([xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) for h in sets], pa.int64())
                fp = np.array([wide(h) for h in sets], np.int64).reshape(-1, WORDS)
                sh = pa.array([np.unique(h.astype(np.uint32)).view(np.int32) for h in sets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), sk, *[pa.array(fp[:, i]) for i in range(WORDS)], pa.array([len(h) for h in sets], pa.int32()), sh], names=[key, *NODE, "sh"])
        give_back()

    return docs.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, sk long, f0 long, f1 long, f2 long, f3 long, size int, sh array<int>")


def tables_for(nodes: int, least: float) -> np.ndarray:
    """Bit places by table."""
    bits = min(20, max(10, math.ceil(math.log2(max(2, nodes)))))
    agree = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** bits
    n = math.ceil(math.log(MISS) / math.log(1 - agree))
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(64 * WORDS, bits, replace=False) for _ in range(n)])


def small_links(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join all sets of which one has at most FEW shingles and that reach `least`; of (sk, sh), a row a node."""
    few = FEW if least >= 0.8 else 0
    most = [int(i * (1 - least) / least + 1e-9) for i in range(few + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                rows = [[], [], [], []]
                for sk, sh in zip(b.column("sk").slice(lo, 2000).to_pylist(), b.column("sh").slice(lo, 2000), strict=True):
                    x = sh.values.to_numpy().astype(np.uint64)
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                    n, total = len(x), x.sum(dtype=np.uint64)
                    i, j = np.triu_indices(n, 1)
                    for out, sums in ((0, np.array([total])), (1, total - x), (2, total - x[i] - x[j])):
                        if 0 < n - out <= few and out <= most[n - out]:
                            rows[0].append(sums.view(np.int64))
                            rows[1] += [n - out] * len(sums)
                            rows[2] += [out] * len(sums)
                            rows[3] += [sk] * len(sums)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows[0])), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["k", "n", "out", "sk"])

    of = written(nodes.filter(F.size("sh").between(1, few + 2)).select("sk", "sh").mapInArrow(run, "k long, n int, out int, sk long"), "subsets")
    lead = of.groupBy("k", "n").agg(F.min(F.struct("out", "sk")).alias("lead"), F.count("*").alias("rows")).filter("rows > 1")
    near = F.element_at(F.array(*[F.lit(m) for m in most]), F.col("n") + 1)
    both = of.join(lead.hint("shuffle_hash"), ["k", "n"]).filter((F.col("sk") != F.col("lead.sk")) & (F.col("out") + F.col("lead.out") <= near))
    return both.select(F.col("lead.sk").alias("a"), F.col("sk").alias("b")).distinct()


def dealt(nodes: DataFrame, places: np.ndarray, extra: list[str]) -> DataFrame:
    """Nodes by table key, in the order of keys."""
    names = [*NODE, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(places.shape[1], dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                fp = np.stack([part.column(f"f{i}").to_numpy() for i in range(WORDS)], axis=1)
                bits = np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(len(fp), -1), axis=1)
                keys = np.concatenate([(bits[:, p].astype(np.int64) @ power) * 4096 + t for t, p in enumerate(places)])
                row = pa.array(np.tile(np.arange(len(fp)), len(places)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[part.column(c).take(row) for c in names]], names=["k", *names])

    kinds = ", ".join(f"{c} {'int' if c == 'size' else 'long'}" for c in names)
    return nodes.select(*names).mapInArrow(run, f"k long, {kinds}").repartition(partitions(nodes.sparkSession), "k").sortWithinPartitions("k", "sk")


class BKForest:
    """BK-trees of shards that stand one after the other, built level by level, all at once.

    A node's children are keyed by their distance to it; nodes with equal
    fingerprints are leaves under the first of them. A shard's first node is its
    root, and nodes come after the ones they hang under.
    """

    def __init__(self, words: list[np.ndarray], root: np.ndarray):
        self.words, self.root = [w.view(np.uint64) for w in words], root
        n = len(root)
        up, dist = np.full(n, -1), np.zeros(n, np.int64)
        rows = np.flatnonzero(root != np.arange(n))
        at = root[rows]
        while len(rows):
            d = self.distance(rows, at)
            _, first, slot = np.unique(at * (64 * WORDS + 1) + d, return_index=True, return_inverse=True)
            child = rows[first][slot]
            stop = (child == rows) | (d == 0)
            up[rows[stop]], dist[rows[stop]] = at[stop], d[stop]
            rows, at = rows[~stop], child[~stop]
        self.child = np.argsort(up, kind="stable")
        self.first = np.searchsorted(up[self.child], np.arange(n + 1))
        self.dist = dist[self.child]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in self.words)

    def before(self, ok, one: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node, a node before it in its shard) within RADIUS that are `ok`: all of them, or one for each node that has one."""
        ahead = np.cumsum(np.arange(len(self.root)) - self.root)
        lo = 0
        while lo < len(ahead):
            hi = max(lo + 1, int(np.searchsorted(ahead, (ahead[lo - 1] if lo else 0) + most)))
            q = np.arange(lo, hi)
            q = q[self.root[q] < q]
            node = self.root[q]
            while len(q):
                d = self.distance(q, node)
                near = d <= RADIUS
                near[near] = ok(q[near], node[near])
                if one:
                    found, at = np.unique(q[near], return_index=True)
                    yield found, node[near][at]
                    left = ~np.isin(q, found)
                    q, node, d = q[left], node[left], d[left]
                else:
                    yield q[near], node[near]
                kids = self.first[node + 1] - self.first[node]
                rep = np.repeat(np.arange(len(q)), kids)
                edge = np.arange(len(rep)) - np.repeat(np.cumsum(kids) - kids, kids) + np.repeat(self.first[node], kids)
                on = (np.abs(self.dist[edge] - d[rep]) <= RADIUS) & (self.child[edge] < q[rep])
                q, node = q[rep[on]], self.child[edge[on]]
            lo = hi


def uncrowded(found: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of shards in which no node has more than CROWD; of other shards each node that has a pair, paired with itself. Holds CROWD pairs a node and a step's."""
    n, full = np.zeros(len(root), np.int64), np.zeros(len(root), bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, most = 0, len(root) * CROWD
    for i, j in found:
        n += np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
        full[root[n > CROWD]] = True
        held.append((i, j))
        size += len(i)
        if size > most:
            held = [(i[~full[root[i]]], j[~full[root[i]]]) for i, j in held]
            size = sum(len(i) for i, _ in held)
    for i, j in held:
        yield i[~full[root[i]]], j[~full[root[i]]]
    own = np.flatnonzero((n > 0) & full[root])
    yield own, own


def candidates(rows: DataFrame, least: float, across: bool) -> DataFrame:
    """(a, b): pairs that may reach `least`, for each node one with a node before it; across: pairs that lie across components (column root), and a = b for nodes in a crowd."""

    def pairs(x: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.concatenate(([True], x[0][1:] != x[0][:-1]))
        forest = BKForest(x[2 : 2 + WORDS], np.maximum.accumulate(np.where(start, np.arange(len(start)), 0)))

        def ok(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            alike = np.minimum(x[6][i], x[6][j]) >= least * np.maximum(x[6][i], x[6][j])
            return alike & (x[7][i] != x[7][j]) if across else alike

        found = forest.before(ok, not across, SMALL << 14)
        return uncrowded(found, forest.root) if across else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy() for c in b.columns]
            held = [np.concatenate(c) for c in zip(held, new, strict=True)] if held else [c.copy() for c in new]
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            yield from out([c[:whole] for c in held])
            held = [c[whole:] for c in held]
        if held:
            yield from out(held)
        held = None
        give_back()

    def out(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(x[0]):
            for i, j in pairs(x):
                if len(i):
                    a, b = x[1][i], x[1][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def crowd_pairs(crowd: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of nodes (sk, root, sh) of different components whose sets can reach `least`; none that do is missing.

    Two sets with o in common have one among the first n - o + 1 of each, in any
    order; the shingles that few of these nodes have come first. And they differ
    in no fewer shingles than their parities do: bits of how many shingles fall
    to each of 1,024 places, even or odd.
    """
    each = crowd.select("sk", "root", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(63))
    words = [f"p{i}" for i in range(16)]
    odd = each.groupBy("sk").agg(*[F.coalesce(F.bit_xor(F.when(F.shiftright("s", 6).bitwiseAND(15) == i, bit)), F.lit(0)).alias(w) for i, w in enumerate(words)])
    use = each.groupBy("s").agg(F.count("*").alias("uses"), (F.min("root") != F.max("root")).alias("across"))
    ranked = each.join(use.hint("shuffle_hash"), "s").withColumn("place", F.row_number().over(Window.partitionBy("sk").orderBy("uses", "s")))
    first = lambda share: F.col("place") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1
    heads = ranked.filter(F.col("across") & first(least)).select("s", "sk", "root", "n", "place", first(2 * least / (1 + least)).alias("short"))
    heads = written(heads.join(odd.hint("shuffle_hash"), "sk"), "heads")
    x, y = heads.alias("x"), heads.filter("short").alias("y")  # y is the smaller one
    both = F.col("x.n") + F.col("y.n")
    fit = F.struct("y.n", "y.sk") < F.struct("x.n", "x.sk")
    fit &= (F.col("x.root") != F.col("y.root")) & (F.col("y.n") >= least * F.col("x.n") - 1e-9)
    fit &= F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1 >= least / (1 + least) * both - 1e-9
    fit &= sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0)) <= (1 - least) / (1 + least) * both + 1e-9
    met = x.join(y.hint("shuffle_hash"), (F.col("x.s") == F.col("y.s")) & fit)
    return met.select(F.least("x.sk", "y.sk").alias("a"), F.greatest("x.sk", "y.sk").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same >= least * (len(x) + len(y) - same) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ids = pairs.select(F.col("a").alias("sk")).unionAll(pairs.select(F.col("b").alias("sk"))).distinct()
    some = written(sets.join(ids.hint("shuffle_hash"), "sk", "left_semi").groupBy("sk").agg(F.first("sh").alias("sh")), "sets")
    first = pairs.join(some.select(F.col("sk").alias("a"), F.col("sh").alias("sa")).hint("shuffle_hash"), "a")
    return first.join(some.select(F.col("sk").alias("b"), F.col("sh").alias("sb")).hint("shuffle_hash"), "b").mapInArrow(run, "a long, b long")


def near_sets(docs: DataFrame, key: str, text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(key, root): rows of one root are linked by texts whose shingle sets have Jaccard similarity `least` or more."""
    spark = docs.sparkSession
    sets = written(with_sets(docs.select(key, text), key, shingle), "shingles")
    few = sets.filter(F.size("sh") <= FEW + 2).groupBy("sk").agg(F.first("sh").alias("sh"))
    close = written(small_links(few, least), "links")
    nodes = sets.filter(F.size("sh") > (FEW if least >= 0.8 else 0)).groupBy("sk").agg(*[F.first(c).alias(c) for c in NODE[1:]])
    nodes = written(nodes, "nodes")
    places = tables_for(nodes.count(), least)
    pairs = written(candidates(dealt(nodes, places, []), least, False), "pairs")
    release(spark)
    links = written(verified(pairs, sets, least).unionAll(close), "links")
    release(spark)
    roots = connected_components(links, "a", "b")
    rooted = nodes.join(roots.hint("shuffle_hash"), F.col("sk") == F.col("node"), "left").select(*NODE, F.coalesce("root", "sk").alias("root"))
    rooted = written(rooted, "rooted")
    release(spark)
    found = written(candidates(dealt(rooted, places, ["root"]), least, True), "pairs")
    release(spark)
    more, crowd = found.filter("a <> b"), found.filter("a = b").select(F.col("a").alias("sk"))
    if crowd.limit(1).count():
        of = sets.join(crowd.hint("shuffle_hash"), "sk", "left_semi").groupBy("sk").agg(F.first("sh").alias("sh"))
        of = written(of.join(rooted.select("sk", "root").hint("shuffle_hash"), "sk"), "crowd")
        more = written(more.unionAll(crowd_pairs(of, least)).distinct(), "pairs")
        release(spark)
    discard(pairs, rooted)
    if more.limit(1).count():
        late = written(verified(more, sets, least), "links")
        release(spark)
        if late.limit(1).count():
            roots = connected_components(links.unionAll(late), "a", "b")
    return sets.select(key, "sk").join(roots.hint("shuffle_hash"), F.col("sk") == F.col("node"), "left").select(key, F.coalesce("root", "sk").alias("root"))
