"""Comment threads as parent-pointer rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMMENT_FIELDS
from ..functions.features import parent_comment
from ..functions.nested import comments_of
from ..sources.shared import written


def flatten_threads(comments: DataFrame, id="id", parent="parent_id", shared: str | None = None) -> DataFrame:
    """Comments reachable from a root (null parent) with _depth, _is_top_level and _parent_comment_id.

    Pointer doubling: after k rounds a comment points 2^k comments up, or knows
    its depth, so a thread of any depth takes a logarithm of rounds. Every round
    is written to the shared folder before the next one reads it, so lineage
    stays short and a lost executor costs a round. Comments of a ring that no
    root reaches are not in the result; one that a root reaches is an error.
    """
    known = comments.filter(F.col("body").isNotNull()) if "body" in comments.columns else comments
    steps = known.select(F.col(id).alias("_node"), F.col(parent).alias("_up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("_n"))
    steps = written(steps.filter("_node is not null").distinct(), "steps")
    found, live, reach = steps.filter("_up is null"), steps.filter("_up is not null"), 1
    n_nodes = steps.select("_node").distinct().count()
    while live.limit(1).count():
        if reach > n_nodes:  # what still climbs goes round
            if found.filter(F.col("_n") >= n_nodes).limit(1).count():
                raise RuntimeError("a thread's comments answer each other in a ring")
            break
        on = found.unionByName(live).select(F.col("_node").alias("_at"), F.col("_up").alias("_next"), F.col("_n").alias("_more"))
        far = live.join(on.hint("shuffle_hash"), F.col("_up") == F.col("_at")).select("_node", F.col("_next").alias("_up"), (F.col("_n") + F.col("_more")).alias("_n"))
        far = written(far.distinct(), "steps")
        found, live, reach = found.unionByName(far.filter("_up is null")), far.filter("_up is not null"), reach * 2
    up = found.select(F.col("_node").alias("_at"), (F.col("_n") + 1).cast("int").alias("_depth"))
    tops = known.filter(F.col(parent).isNull()).withColumn("_depth", F.lit(0))
    out = tops.unionByName(known.join(up.hint("shuffle_hash"), F.col(parent) == F.col("_at")).drop("_at"))
    return out.withColumns({"_is_top_level": F.col("_depth") == 0, "_parent_comment_id": F.col(parent)})


#: Comments that leave a task together.
BATCH = 4096


def flatten_nested(trees: DataFrame, tree: str = "tree", id: str = "submission_id", fields: list[str] = COMMENT_FIELDS) -> DataFrame:
    """Comments of nested trees {comment: {fields, replies: {...}}} in JSON, a row each, with _depth and its companions.

    One narrow stage, whatever the depth: a tree's text is read once. Comments
    without a body go with what is below them; of a comment that occurs twice in
    a tree the later one in reading order stays; a tree that is null or not such
    JSON has no comments.
    """
    kind = trees.schema[id].dataType.simpleString()
    columns = ["_submission_id", "_id", *fields, "_depth"]
    schema = f"_submission_id {kind}, _id string, {', '.join(f'{c} string' for c in fields)}, _depth int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, places = [], []

            def done(b=b) -> pa.RecordBatch:
                values = [pa.array([f.get(c) for _, _, f in own], pa.string()) for c in fields]
                out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int64())), pa.array([i for i, _, _ in own], pa.string()), *values, pa.array([d for _, d, _ in own], pa.int32())], names=columns)
                own.clear()
                places.clear()
                return out

            for i, text in enumerate(b.column(1)):
                try:
                    found = comments_of(text.as_py() or "", fields)
                except ValueError:
                    continue
                for at in range(0, len(found), BATCH):
                    own += found[at : at + BATCH]
                    places += [i] * len(found[at : at + BATCH])
                    if len(own) >= BATCH:
                        yield done()
            yield done()

    flat = trees.select(F.col(id), F.col(tree)).mapInArrow(run, schema)
    return flat.withColumns({"_is_top_level": F.col("_depth") == 0, "_parent_comment_id": parent_comment(F.col("parent_id"))})


def with_submission(comments: DataFrame, posts: DataFrame, link="submission_id", id="id", fields: tuple[str, ...] = ("title", "score")) -> DataFrame:
    """Comments with fields of their submission; both sides may be large."""
    side = posts.select(F.col(id).alias("_sid"), *[F.col(f).alias(f"_submission_{f}") for f in fields])
    return comments.join(side.hint("merge"), F.col(link) == F.col("_sid"), "left").drop("_sid")
