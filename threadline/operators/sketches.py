"""Distinct counts that can be merged: a sketch a group, rolled up to any level and refreshed with new rows.

A sketch of 2^precision places has a relative standard error of
1.04 / sqrt(2^precision) and a size that does not depend on what was counted, so
one scan of the posts answers all levels, and a month that is added needs no
look at the months before. `stats` has the exact counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 12


def error_bound(precision: int = PRECISION, deviations: float = 4.0) -> float:
    """The relative error that is kept but for one count in 16,000."""
    return deviations * 1.04 / math.sqrt(1 << precision)


def distinct_sketches(df: DataFrame, by: list[Column | str], of: str, precision: int = PRECISION) -> DataFrame:
    """(by, rows, sketch): nulls are counted as rows only; a group of nulls has an empty sketch."""
    sketch = F.hll_sketch_agg(F.xxhash64(of), precision) if df.schema[of].dataType.simpleString() not in ("int", "bigint", "string", "binary") else F.hll_sketch_agg(of, precision)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), sketch.alias("sketch"))


def rolled_up(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of fewer columns; no column gives one row."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch", True).alias("sketch"))


def refreshed(sketches: DataFrame, df: DataFrame, by: list[str], of: str, precision: int = PRECISION) -> DataFrame:
    """Stored sketches with those of new rows; rows that were counted before change `rows` but no estimate."""
    return rolled_up(sketches.select(*by, "rows", "sketch").unionByName(distinct_sketches(df, by, of, precision)), by)


def estimates(sketches: DataFrame, name: str = "distinct") -> DataFrame:
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
