"""Near-duplicate vectors through a forest of random-projection trees.

A tree splits the vectors again and again: a node has a random direction of its
own (one of POOL, chosen by its path) and cuts at the median, on it, of the
sample rows that came to the node; vectors within SPILL / sqrt(components) of
the cut go to both sides. Where fewer than NODE_ROWS sample rows are left, the sample of the
nearest node above serves. Nodes of about LEAF vectors, and nodes that a cut
would copy more than half of, are leaves. The number of trees follows from the
depth, so that a pair at 0.95 itself is expected to share no leaf in at most MISS
of all cases (KEEP: the chance that one level keeps it together, somewhat less
than measured on vectors of 64 components). A median that runs through a crowded
group parts more of its pairs; such groups are found to 95 % and more in tests.

Every row is routed through every tree. Within a leaf all pairs are compared,
and those found are verified in double precision. A pair counts in the first of
the leaves that both its vectors are in, which the rows' lists of leaves tell;
a leaf yields a count a vector and edges that span its links, never the pairs.

Equal vectors are one node of the search and count as many as they are, so a
vector that a third of all rows hold is compared once. Leaves above LEAF_MAX
rows are dealt out as pairs of blocks, so that no task holds one whole.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing, and are components of their own;
vectors of different lengths do not link; repeated rows are vectors that link
with each other; a component without any id has none; `kept` compares nulls as
equal; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, partitions, table, written
from .simhash import union

LEAF, LEAF_MAX, SPILL, FIT_ROWS, NODE_ROWS, POOL = 2048, 8192, 0.064, 8192, 48, 128
KEEP, MISS = 0.935, 0.004
COSINE = 0.95
#: Links of one leaf above which its components are found in the matrix instead of a list.
LISTED_LINKS = 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that nothing over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(tree: int, dim: int) -> np.ndarray:
    """(dim, POOL) random unit vectors of a tree."""
    r = np.random.default_rng([tree, dim]).standard_normal((dim, POOL))
    return r / np.sqrt((r * r).sum(axis=0))


def choice(path: np.ndarray) -> np.ndarray:
    """The direction of the node at a path."""
    x = path.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(POOL)).astype(np.int64)


class Tree:
    """Cuts of a tree: for each fitted node the medians on all directions, its children, and the depth at which routing through it ends."""

    def __init__(self, sample: np.ndarray, tree: int, n: int, leaf: int, spill: float):
        p = sample @ directions(tree, sample.shape[1])
        self.cuts: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.depth: list[int] = []
        todo = [(np.arange(len(p)), 1, 0, -1, 0)]
        while todo:
            rows, path, level, above, side = todo.pop()
            if len(rows) < NODE_ROWS and above >= 0:
                continue  # the node above serves
            me = len(self.cuts)
            if above >= 0:
                self.child[above][side] = me
            mine = p[rows]
            self.cuts.append(np.median(mine, axis=0) if len(rows) else np.zeros(POOL))
            self.child.append([me, me])
            more = max(0, math.ceil(math.log2(max(1.0, len(rows) * n / max(1, len(p)) / leaf))))
            d = int(choice(np.array([path]))[0])
            off = mine[:, d] - self.cuts[me][d]
            if more and (np.abs(off) <= spill).mean() > 0.5:
                more = 0
            self.depth.append(level + more)
            if more:
                todo.append((rows[off <= 0], path * 2, level + 1, me, 0))
                todo.append((rows[off > 0], path * 2 + 1, level + 1, me, 1))
        self.table = np.array(self.cuts), np.array(self.child), np.array(self.depth)


def trees_for(depth: int) -> int:
    """Trees after which at most MISS of the pairs at the threshold are expected to have met in none."""
    if depth == 0:
        return 1
    return max(2, math.ceil(math.log(MISS) / math.log(1 - KEEP**depth)))


def spill_of(dim: int) -> float:
    """Projections on a random direction spread as 1 / sqrt(dim), and so does what goes to both sides."""
    return SPILL / math.sqrt(dim)


def fit_forest(sample: np.ndarray, n: int, leaf: int, spill: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    return [Tree(sample, t, n, leaf, spill).table for t in range(trees_for(depth))]


def route(x: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]], spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves that they come to, in the order of rows and leaves; a leaf's number has its tree above its path."""
    all_rows, leaves = [], []
    for t, (cuts, child, depth) in enumerate(forest):
        p = x @ directions(t, x.shape[1])
        rows, path, node, level = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(len(x), np.int64), 0
        while True:
            done = depth[node] <= level
            all_rows.append(rows[done])
            leaves.append(path[done] | (t << 56))
            rows, path, node = rows[~done], path[~done], node[~done]
            if not len(rows):
                break
            d = choice(path)
            off = p[rows, d] - cuts[node, d]
            left, right = off <= spill, off > -spill
            rows = np.concatenate((rows[left], rows[right]))
            path, node = np.concatenate((path[left] * 2, path[right] * 2 + 1)), np.concatenate((child[node[left], 0], child[node[right], 1]))
            level += 1
    row, leaf = np.concatenate(all_rows), np.concatenate(leaves)
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def linked_matrix(x: np.ndarray, y: np.ndarray, cosine: float, step: int = 1024) -> np.ndarray:
    """Whether rows of x and y reach the cosine."""
    u, v = unit(x), unit(y)
    out = np.empty((len(x), len(y)), bool)
    for at in range(0, len(u), step):
        s = u[at : at + step] @ v.T
        got = s >= cosine
        i, j = np.nonzero(np.abs(s - cosine) <= 1e-9)  # too near to tell from scaled vectors
        if len(i):
            a, b = x[i + at], y[j]
            exact = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            fine = np.isfinite(exact)  # else squares are out of range, and the scaled vectors decide
            got[i[fine], j[fine]] = exact[fine] >= cosine
        out[at : at + step] = got
    return out


def met_before(a: pa.ListArray, b: pa.ListArray, step: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """In blocks of rows of a: which rows of b share an earlier leaf with them."""
    own = np.unique(np.concatenate((a.flatten().to_numpy(), b.flatten().to_numpy())))

    def incidence(lists: pa.ListArray) -> np.ndarray:
        m = np.zeros((len(lists), max(1, len(own))), np.float32)
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        m[rows, np.searchsorted(own, lists.flatten().to_numpy())] = 1
        return m

    x, y = incidence(a), incidence(b)
    for at in range(0, len(x), step):
        yield at, x[at : at + step] @ y.T > 0


def spanning(linked: np.ndarray) -> np.ndarray:
    """For the nodes of a bipartite or square matrix (rows, then columns; the same ones where it is square and symmetric) the smallest node of their component."""
    n, m = linked.shape
    if linked.sum() <= LISTED_LINKS:
        parent = np.arange(n + m)
        i, j = np.nonzero(linked)
        union(parent, i, n + j)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        return parent
    left, right = np.arange(n), np.arange(n, n + m)
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], n + m).min(axis=0))
        new_left = np.minimum(left, np.where(linked, new_right[None, :], n + m).min(axis=1))
        if (new_left == left).all() and (new_right == right).all():
            return np.concatenate((left, right))
        left, right = new_left, new_right


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of all rows, key null for vectors that cannot link; (gid, key, dim, vec, copies, least) of distinct ones."""
    v = F.col(vec_col)
    if vectors.schema[vec_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    key = F.when(fine, F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(7), v).alias("b")))  # 128 bits
    rows = written(vectors.select(F.col(id_col).alias("vec_id"), key.alias("key"), F.when(fine, v).alias("vec")), "vectors")
    groups = rows.filter("key is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "key"), written(groups.withColumn("dim", F.size("vec")).withColumn("gid", F.monotonically_increasing_id()), "groups")


def forest_links(groups: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, others): edges a, b that span the components of linked vectors (gids), and counts of rows linked with a (b is null)."""
    spark = groups.sparkSession
    forests: dict[int, list] = {}
    most = LEAF_MAX
    for r in groups.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row for each vector length
        sample = groups.filter(F.col("dim") == r.dim).orderBy(F.xxhash64("key")).limit(FIT_ROWS).select("vec").toArrow()["vec"].combine_chunks()
        forests[r.dim] = fit_forest(unit(matrix(sample)), r.n, LEAF, spill_of(r.dim))
    shared = spark.sparkContext.broadcast(forests)  # FIT_ROWS / NODE_ROWS nodes of POOL cuts a tree at most
    kind = groups.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                row, leaf = route(unit(matrix(part.column("vec"))), shared.value[dim], spill_of(dim))
                first = np.searchsorted(row, row)  # of its row's leaves
                before = np.arange(len(row)) - first
                ends = np.cumsum(before)
                earlier = leaf[np.repeat(first - (ends - before), before) + np.arange(int(ends[-1]))]
                take = pa.array(row)
                for at in range(0, len(row), 20_000):
                    s = slice(at, at + 20_000)
                    offsets = np.concatenate(([ends[at] - before[at]], ends[s])).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(earlier[offsets[0] : offsets[-1]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row[s]), dim, np.int32)), pa.array(leaf[s]), *[part.column(c).take(take[at : at + 20_000]) for c in ("gid", "copies", "vec")], lists],
                        names=["dim", "leaf", "gid", "copies", "vec", "earlier"],
                    )

    routed = groups.select("dim", "gid", "copies", "vec").mapInArrow(run, f"dim int, leaf long, gid long, copies long, vec {kind}, earlier array<long>")
    leaf = ["dim", "leaf"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at, n = np.unique(route(unit(matrix(b.filter(pa.array(dims == dim)).column("vec"))), shared.value[dim], spill_of(dim))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(at), pa.array(n)], names=["dim", "leaf", "n"])

    sizes = groups.select("dim", "vec").mapInArrow(counted, "dim int, leaf long, n long").groupBy(*leaf).agg(F.sum("n").alias("n"))
    big = written(sizes.filter(F.col("n") > most), "leaves")
    if big.limit(1).count():
        j = routed.join(big.hint("shuffle_hash"), leaf, "left")
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / most).cast("int")
        j = j.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
        j = j.select(*routed.columns, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = j.select(*leaf, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "gid", "copies", "vec", "earlier")
    else:
        dealt = routed.select(*leaf, F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("mine"), "gid", "copies", "vec", "earlier")
    cell = [*leaf, "x", "y"]
    dealt = dealt.repartition(partitions(spark), *cell).sortWithinPartitions(*cell)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            gid, mine, copies = (t[c].to_numpy() for c in ("gid", "mine", "copies"))
            vec, earlier = matrix(t["vec"].combine_chunks()), t["earlier"].combine_chunks()
            same = last[2] == last[3]
            p, q = (np.arange(len(gid)),) * 2 if same else (np.flatnonzero(mine == last[2]), np.flatnonzero(mine == last[3]))
            linked = linked_matrix(vec[p], vec[q], cosine)
            if same:
                np.fill_diagonal(linked, False)
            if not linked.any():
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["a", "b", "others"])
            count = np.zeros(len(gid), np.int64)
            for at, met in met_before(earlier.take(pa.array(p)), earlier.take(pa.array(q))):
                new = linked[at : at + len(met)] & ~met
                count[p[at : at + len(met)]] += new @ copies[q]
                if not same:
                    count[q] += copies[p[at : at + len(met)]] @ new
            node = np.concatenate((gid[p], gid[q]))
            root = spanning(linked)
            a, b = node, node[root]
            off = a != b
            some = count > 0
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((a[off], gid[some]))), pa.array(np.concatenate((b[off], gid[some])), mask=np.repeat([False, True], [off.sum(), some.sum()])), pa.array(np.concatenate((np.zeros(off.sum(), np.int64), count[some])))],
                names=["a", "b", "others"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in cell], axis=1)
            cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                k = tuple(keys[s].tolist())
                if k != last:
                    if held:
                        yield done()
                    held, last = [], k
                held.append(b.slice(s, e - s))
        if held:
            yield done()

    return dealt.mapInArrow(compare, "a long, b long, others long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row a vector."""
    rows, groups = distinct_vectors(vectors, id_col, vec_col)
    links = written(forest_links(groups, cosine), "links")
    others = links.filter("b is null").groupBy("a").agg(F.sum("others").alias("others"))
    roots = connected_components(links.filter("b is not null"), "a", "b")
    g = groups.select("gid", "key", "copies", "least").join(roots.hint("shuffle_hash"), F.col("gid") == F.col("node"), "left")
    g = g.withColumn("root", F.coalesce("root", "gid")).join(others.hint("shuffle_hash"), F.col("gid") == F.col("a"), "left")
    least = g.groupBy("root").agg(F.min("least").alias("component_id"))
    g = g.join(least.hint("shuffle_hash"), "root").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("valid"))
    j = rows.join(g.hint("shuffle_hash"), "key", "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return j.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
