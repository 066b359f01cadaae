"""Exact search among vectors by metric partitions.

Vectors are dealt to cells around anchors: of a node with more than `most`
vectors a bounded sample gives anchors, far from each other and in the middle of
what is nearest to them, and every vector goes to the nearest; nodes that are still larger are split
again by anchors of their own. A cell keeps its centre and its reach, the
largest distance from it. By the triangle inequality two cells hold vectors
within a radius of each other only if their centres are at most the radius and
both reaches apart, so pairs of nodes that may touch are followed down the tree,
and of two cells that touch only those vectors meet that are near enough to the
other one's centre. One group of work is a pair of cells, so it is never larger
than twice `most`, however dense the data.

How much this saves is the data's: vectors without any structure in many
dimensions are all about as far from each other, and then all cells touch.
`compared_share` says how many pairs are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import small, written

#: Vectors in a cell, anchors of a node, and vectors of a node from which its anchors are taken.
MOST, ANCHORS, SAMPLE = 1024, 16, 1000  # Spark cuts a sample of at most 1,000 before it is shuffled


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt by a key whose groups are few, small in bytes and long in work: a number of partitions that is given is not coalesced by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of vectors of one length."""
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows, from differences, so that equal rows are at distance zero."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = x[:, j, None] - y[None, :, j]
        out += d * d
    return np.sqrt(out)


#: The rung of a pair that is above all radii.
NEVER = 255


def rungs(x: np.ndarray, y: np.ndarray, radii: list[float]) -> np.ndarray:
    """The first of the rising radii that each distance is not above.

    Squared distances come from one product; where rounding could decide, they
    are computed again from differences.
    """
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    if len(x) and len(y) and max(nx.max(), ny.max()) < 1 << 22 and (x == np.rint(x)).all() and (y == np.rint(y)).all():
        return whole_rungs(x, y, nx, ny, radii)
    square = nx[:, None] + ny[None, :] - 2.0 * (x @ y.T)
    unsure = 1e-10 * (nx[:, None] + ny[None, :])
    doubt = np.zeros(square.shape, bool)
    for r in radii:
        doubt |= np.abs(square - r * r) <= unsure
    i, j = np.nonzero(doubt)
    out = np.zeros(square.shape, np.uint8)
    for r in radii:
        out += square > r * r
    for at in range(0, len(i), 1 << 16):
        d = x[i[at : at + (1 << 16)]] - y[j[at : at + (1 << 16)]]
        exact = np.sqrt((d * d).sum(axis=1))
        out[i[at : at + (1 << 16)], j[at : at + (1 << 16)]] = np.searchsorted(np.array(radii), exact, side="left")
    out[out == len(radii)] = NEVER
    return out


def whole_rungs(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, radii: list[float]) -> np.ndarray:
    """The same of short vectors of whole numbers: their squared distances are whole and below 2^24, so single precision holds them."""
    f = np.float32
    square = (-2 * x).astype(f) @ y.T.astype(f)
    square += nx.astype(f)[:, None]
    square += ny.astype(f)[None, :]
    out = np.zeros(square.shape, np.uint8)
    for r in radii:
        most = math.floor(min(r * r, float(1 << 24)))
        most += (math.sqrt(most + 1) <= r) - (math.sqrt(most) > r)
        out += square > f(most)
    out[out == len(radii)] = NEVER
    return out


def farthest_first(v: np.ndarray, k: int) -> np.ndarray:
    """Rows that are each as far as can be from those before; fewer than k if there are no more different ones."""
    chosen = [0]
    near = distances(v, v[:1])[:, 0]
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(v, v[chosen[-1:]])[:, 0])
    return v[chosen]


def anchors_of(v: np.ndarray, k: int = ANCHORS, rounds: int = 6) -> np.ndarray:
    """Anchors of a node's sample: far from each other among a few, then moved to the middle of what is nearest to them, so that lone outliers do not take most."""
    a = farthest_first(v[: 4 * k], k)
    for _ in range(rounds):
        near = distances(v, a).argmin(axis=1)
        a = np.stack([v[near == i].mean(axis=0) for i in np.unique(near)])
    return a if len(np.unique(distances(v, a).argmin(axis=1))) > 1 else farthest_first(v, 2)


class Block(NamedTuple):
    """Rows of a task's vectors that lie together."""

    rows: np.ndarray
    centre: np.ndarray
    reach: float


def blocks(v: np.ndarray, rows: np.ndarray, size: int = 1024) -> list[Block]:
    """The given rows in blocks of at most `size` around anchors; equal vectors are cut anywhere."""
    if not len(rows):
        return []
    if len(rows) <= size:
        c = v[rows].mean(axis=0)
        return [Block(rows, c, float(distances(v[rows], c[None]).max()) * (1 + 1e-9))]
    x = v[rows]
    near = distances(x, anchors_of(x[:: max(1, len(x) // SAMPLE)], split_into(len(rows), size))).argmin(axis=1)
    parts = [rows[near == i] for i in np.unique(near)]
    if len(parts) == 1:
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    return [b for p in parts for b in blocks(v, p, size)]


def block_pairs(one: list[Block], other: list[Block]) -> list[tuple[float, int, int]]:
    """(gap, i, j) of all pairs, the least gap first: no two vectors of them are nearer than that."""
    if not one or not other:
        return []
    d = distances(np.stack([b.centre for b in one]), np.stack([b.centre for b in other])) * (1 - 1e-9)
    gap = d - np.array([b.reach for b in one])[:, None] - np.array([b.reach for b in other])[None, :]
    order = np.lexsort((d.ravel(), np.maximum(gap, 0).ravel()))
    return [(float(gap.flat[o]), int(o) // len(other), int(o) % len(other)) for o in order]


def split_into(n: int, most: int) -> int:
    """Anchors for a node of n vectors: twice the cells it needs, ANCHORS at most."""
    return min(ANCHORS, max(2, math.ceil(2 * n / most)))


def prepared(df: DataFrame, id: str, vec: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(id, node, v): vectors that can be compared, each group of `within` (and each length) a root of its own."""
    v = F.col(vec).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    root = F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(within)], F.size(v).alias("n")))
    return df.filter(fine & (F.size(v) > 0)).select(F.col(id).alias("id"), root.alias("node"), v.alias("v"))


def dealt(points: DataFrame, most: int) -> DataFrame:
    """(id, cell, v): nodes split until none has more than `most` vectors, or no two different ones."""
    schema = "node string, anchors array<array<double>>"

    def anchors(key: tuple, t: pa.Table) -> pa.Table:
        a = anchors_of(matrix(t["v"]), split_into(t["n"][0].as_py(), most))
        return pa.table({"node": [key[0].as_py()], "anchors": pa.array([a.tolist()], pa.list_(pa.list_(pa.float64())))})

    whole, open_ = [], points
    while True:
        large = open_.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("node", "n")
        if not large.limit(1).count():
            whole.append(open_)
            break
        large = written(large, "large")
        rows = open_.join(small(large.withColumn("more", F.lit(True))), "node", "left")
        whole.append(rows.filter("more is null").drop("more", "n"))
        rows = rows.filter("more").drop("more")
        drawn = rows.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id"), "id"))).filter(F.col("r") <= SAMPLE)
        found = written(drawn.select("node", "v", "n").groupBy("node").applyInArrow(anchors, schema), "anchors")
        split = found.filter(F.size("anchors") > 1)
        near = F.array_min(F.transform("anchors", lambda a, i: F.struct(distance(F.col("v"), a).alias("d"), (i + 1).alias("i"))))["i"]
        # one anchor only: the sample's vectors are all equal, and so the node cannot be split by it
        stuck = rows.join(small(found.filter(F.size("anchors") == 1).select("node")), "node", "left_semi")
        whole.append(stuck.select("id", "node", "v"))
        open_ = written(rows.join(small(split), "node").select("id", F.concat("node", F.lit("/"), near.cast("string")).alias("node"), "v"), "dealt")
    out = whole[0]
    for w in whole[1:]:
        out = out.unionByName(w)
    return written(out.withColumnRenamed("node", "cell").select("id", "cell", "v"), "cells")


def centres(cells: DataFrame) -> DataFrame:
    """(node, parent, centre, reach, n, leaf) of all cells and of the nodes above them."""
    schema = "node string, centre array<double>, reach double, n long"

    def of(key: tuple, t: pa.Table) -> pa.Table:
        v = matrix(t["v"])
        c = v.mean(axis=0)
        return pa.table({"node": [key[0].as_py()], "centre": [c.tolist()], "reach": [float(distances(v, c[None]).max()) * (1 + 1e-9)], "n": [len(v)]})

    up = F.when(F.instr("node", "/") > 0, F.regexp_replace("node", r"/[^/]*$", ""))
    level = written(spread(cells, "cell").groupBy("cell").applyInArrow(of, schema).withColumns({"leaf": F.lit(True), "parent": up}), "centres")
    tree = [level]
    depth = int(level.agg(F.max(F.size(F.split("node", "/")))).first()[0] or 1)
    made = level
    for d in range(depth - 1, 0, -1):  # a node's reach is bounded by its children's
        of_depth = made.filter(F.size(F.split("node", "/")) == d + 1)
        kids = of_depth.groupBy("parent").agg(F.collect_list(F.struct("centre", "reach", "n")).alias("k"))  # ANCHORS at most
        n = F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        mean = F.aggregate("k", F.transform(F.col("k")[0]["centre"], lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x["centre"], lambda p, q: p + q * x["n"]))
        above = kids.withColumn("n", n).withColumn("centre", F.transform(mean, lambda x: x / F.col("n")))
        above = above.withColumn("reach", F.array_max(F.transform("k", lambda x: distance(F.col("centre"), x["centre"]) + x["reach"])) * (1 + 1e-9))
        above = written(above.select(F.col("parent").alias("node"), "centre", "reach", "n", F.lit(False).alias("leaf")).withColumn("parent", up), "centres")
        tree.append(above)
        made = made.unionByName(above)
    return made


def touching(tree: DataFrame, radius: float) -> DataFrame:
    """(a, b, with both centres and reaches): pairs of cells, a <= b, that may hold vectors within the radius."""
    side = lambda s: tree.select(F.col("node").alias(s), F.col("parent").alias(f"{s}_up"), F.col("centre").alias(f"{s}_centre"), F.col("reach").alias(f"{s}_reach"), F.col("leaf").alias(f"{s}_leaf"))
    a, b = side("a"), side("b")
    near = distance(F.col("a_centre"), F.col("b_centre")) <= (F.col("a_reach") + F.col("b_reach") + radius) * (1 + 1e-9)
    columns = [*a.columns, *b.columns]
    now = a.filter("a_up is null").join(b.filter("b_up is null").hint("merge"), F.col("a") == F.col("b")).select(columns)
    ended = []
    depth = tree.agg(F.max(F.size(F.split("node", "/")))).first()[0] or 1
    for d in range(depth):
        ended.append(now.filter("a_leaf and b_leaf"))
        if d + 1 == depth:
            break
        now = now.filter("not (a_leaf and b_leaf)")
        below = lambda s: side(s).withColumnRenamed(f"{s}_up", "up").withColumn(f"{s}_up", F.col("up"))
        for s in ("a", "b"):  # a node that is not a cell gives way to its children
            kept, rest = now.filter(f"{s}_leaf"), now.filter(f"not {s}_leaf")
            other = [c for c in columns if not c.startswith(s)]
            down = rest.select(F.col(s).alias("up"), *other).join(below(s).hint("merge"), "up").select(columns)
            now = kept.select(columns).unionByName(down)
        now = written(now.filter((F.col("a") <= F.col("b")) & near), "touching")
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.filter((F.col("a") <= F.col("b")) & near)


def paired(points: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """Points (with a cell and v) once for every pair of cells in which they may have a partner: adds pair and side."""
    keep = points.columns
    one = pairs.select(F.struct("a", "b").alias("pair"), F.lit(0).alias("side"), F.col("a").alias("cell"), F.col("b_centre").alias("c"), F.col("b_reach").alias("r"))
    two = pairs.filter("a <> b").select(F.struct("a", "b").alias("pair"), F.lit(1).alias("side"), F.col("b").alias("cell"), F.col("a_centre").alias("c"), F.col("a_reach").alias("r"))
    met = points.join(one.unionByName(two).hint("merge"), "cell")
    return met.filter((distance(F.col("v"), F.col("c")) <= (F.col("r") + radius) * (1 + 1e-9)) | (F.col("pair.a") == F.col("pair.b"))).select("pair", "side", *keep)


def each_pair(points: DataFrame, pairs: DataFrame, radius: float, work: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """What `work` gives for the points of two cells that touch; for a cell with itself, of its points and None."""
    import pyspark.sql.types as T

    empty = pa.table({f.name: pa.array([], {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in T._parse_datatype_string(schema)})

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        pair = key[0].as_py()
        if pair["a"] == pair["b"]:
            return work(t, None)
        x, y = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        return work(x, y) if x.num_rows and y.num_rows else empty

    return spread(paired(points, pairs, radius), "pair").groupBy("pair").applyInArrow(run, schema)


#: Axes of a box at most, and vectors a part of the ones that ask one cell.
AXES, PART = 16, 8192


def axes_of(points: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors in a bounded sample, orthonormal axes along which it is widest. Distances along any such axes bound the whole ones; these bound them best."""
    of: dict[int, list] = {}
    for r in points.orderBy(F.xxhash64("id"), "id").limit(4 * SAMPLE).select("v").collect():
        of.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for n, rows in of.items():
        x = np.array(rows)
        x = x - x.mean(axis=0)
        x /= max(np.abs(x).max(), 1e-300)
        out[n] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES])
    return out


def turned(v: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates along the axes; the first ones themselves for a length that has none."""
    return v @ axes[v.shape[1]] if v.shape[1] in axes else v[:, :AXES].copy()


def box(v: np.ndarray, axes: dict[int, np.ndarray]) -> tuple[list[float], list[float]]:
    """Bounds along the axes, a little wider than rounding could make them."""
    p, more = turned(v, axes), 1e-12 * float(np.abs(v).sum(axis=1).max())
    return (p.min(axis=0) - more).tolist(), (p.max(axis=0) + more).tolist()


def box_gaps(v: np.ndarray, axes: dict[int, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For rows and boxes, what no vector in the box is nearer than."""
    out, p, less = np.empty((len(v), len(lo))), turned(v, axes), 1e-12 * np.abs(v).sum(axis=1)
    for i in range(0, len(v), 256):
        x = p[i : i + 256]
        d = np.zeros((len(x), len(lo)))
        for j in range(x.shape[1]):
            g = np.maximum(np.maximum(lo[None, :, j] - x[:, None, j], x[:, None, j] - hi[None, :, j]), 0)
            d += g * g
        out[i : i + 256] = np.maximum(np.sqrt(d) * (1 - 1e-9) - less[i : i + 256, None], 0)
    return out


class Boxes(NamedTuple):
    """The boxes of one root's cells, in the order of the cells: at which rung and of which component they are, and how large that is."""

    cells: list[str]
    first: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rung: np.ndarray
    label: np.ndarray
    size: np.ndarray


def gathered_boxes(boxes: DataFrame) -> dict[str, Boxes]:
    """(cell, root, lo, hi, rung, label, size) by root, on the driver: a few rows for each cell of a root that has several."""
    of: dict[str, list] = {}
    for r in boxes.collect():
        of.setdefault(r["root"], []).append(r)
    out = {}
    for root, rows in of.items():
        rows.sort(key=lambda r: r["cell"])
        names = [r["cell"] for r in rows]
        first = [i for i, c in enumerate(names) if not i or names[i - 1] != c]
        label = np.empty(len(rows), object)
        label[:] = [r["label"] for r in rows]
        out[root] = Boxes([names[i] for i in first], np.array(first), np.array([r["lo"] for r in rows]), np.array([r["hi"] for r in rows]), np.array([r["rung"] for r in rows]), label, np.array([r["size"] for r in rows]))
    return out


def routed(asks: DataFrame, boxes: dict[str, Boxes], axes: dict[int, np.ndarray], upto: Callable[[np.ndarray, pa.Table, Boxes], np.ndarray], keep: list[str]) -> DataFrame:
    """Asking rows (with root, cell, v and `keep`) once for every other cell that they ask: `upto` says for rows and boxes, by the gaps, up to which rung, or -1."""
    names, parts = ["id", "v", *keep], spread(asks, "id")
    shared = asks.sparkSession.sparkContext.broadcast((boxes, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes, axes = shared.value
        for b in batches:
            whole = pa.Table.from_batches([b])
            for root in whole["root"].unique().to_pylist():
                t, at = whole.filter(pc.equal(whole["root"], root)), boxes.get(root)
                place = {c: i for i, c in enumerate(at.cells)} if at else {}
                for i in range(0, t.num_rows if at else 0, 512):
                    x = t.slice(i, 512)
                    best = np.maximum.reduceat(upto(box_gaps(matrix(x["v"]), axes, at.lo, at.hi), x, at), at.first, axis=1)
                    own = np.array([place.get(c, -1) for c in x["cell"].to_pylist()])
                    best[np.flatnonzero(own >= 0), own[own >= 0]] = -1
                    row, cell = np.nonzero(best >= 0)
                    out = x.select(names).take(pa.array(row)).append_column("cell", pa.array(at.cells, pa.string()).take(pa.array(cell))).append_column("upto", pa.array(best[row, cell].astype(np.int32)))
                    yield from out.combine_chunks().to_batches()

    return parts.mapInArrow(run, ", ".join([*[f"{c} {asks.schema[c].dataType.simpleString()}" for c in names], "cell string", "upto int"]))


def asked(asks: DataFrame, points: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `work` gives for rows that ask a cell (PART or so at a time; a written table) and the points of the cell."""
    loads = small(asks.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = asks.join(loads, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    other = points.join(loads, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    deal = lambda d: d.repartition(parts, "cell", "part").groupBy("cell", "part")
    return deal(one).cogroup(deal(other)).applyInArrow(lambda x, y: work(x, y), schema)


def compared_share(tree: DataFrame, pairs: DataFrame) -> float:
    """Share of all pairs of vectors whose cells touch."""
    n = tree.filter("leaf").select("node", "n")
    met = pairs.join(n.withColumnsRenamed({"node": "a", "n": "na"}).hint("merge"), "a").join(n.withColumnsRenamed({"node": "b", "n": "nb"}).hint("merge"), "b")
    done = met.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")))).first()[0] or 0.0
    total = n.withColumn("root", F.split("node", "/")[0]).groupBy("root").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    return float(done / total) if total else 0.0


def neighbour_pairs(df: DataFrame, radius: float, id: str = "id", vec: str = "embedding", within: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """(a, b): ids of all vectors at most `radius` apart, a < b; exact. A dense group gives all its real pairs."""
    cells = dealt(prepared(df, id, vec, within), most)
    pairs = written(touching(centres(cells), radius), "pairs")
    kind = cells.schema["id"].dataType.simpleString()

    def work(x: pa.Table, y: pa.Table | None) -> pa.Table:
        one = y is None
        y = x if one else y
        near = rungs(matrix(x["v"]), matrix(y["v"]), [radius]) == 0
        i, j = np.nonzero(np.triu(near, 1) if one else near)
        return pa.table({"p": x["id"].take(pa.array(i)), "q": y["id"].take(pa.array(j))})

    found = each_pair(cells, pairs, radius, work, f"p {kind}, q {kind}")
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
