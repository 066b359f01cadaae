"""Derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REGION_COMMUNITIES
from .text import word_count


def epoch_to_timestamp(c: Column) -> Column:
    """Seconds since 1970 in any type; what is no number gives null."""
    return F.timestamp_seconds(c.cast("string").try_cast("double"))


def with_date_parts(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """year, month, day, hour, dayofweek (Monday is 0), date, year_month."""
    t = F.col(ts)
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "dayofweek": F.weekday(t), "date": F.to_date(t), "year_month": F.date_format(t, "yyyy-MM")}
    return df.withColumns({prefix + k: v for k, v in parts.items()})


def text_length(t: Column) -> Column:
    return F.length(F.coalesce(t, F.lit("")))


def text_features(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_length": text_length(F.col(col)), f"{prefix}_word_count": word_count(F.col(col))})


def engagement_ratio(score: Column, comments: Column) -> Column:
    """Comments per point; null at a score of -1."""
    return F.try_divide(comments.cast("double"), score + 1)


def edited_at(c: Column) -> Column:
    """false, null and what is no number give 0, else the epoch."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def blank(c: Column) -> Column:
    """Nulls and the spelled-out None and nan give an empty string."""
    t = c.cast("string")
    return F.when(t.isNull() | t.isin("None", "nan"), "").otherwise(t)


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns that are there, in the list's order."""
    return df.select(*[F.col(c) for c in names if c in df.columns])


def plain_types(df: DataFrame, edited: str = "edited") -> DataFrame:
    """Columns that any sink takes: `edited` as a number, nested columns as JSON; nulls stay null."""
    out = {edited: edited_at(F.col(edited))} if edited in df.columns else {}
    out |= {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.withColumns(out) if out else df


def provenance(df: DataFrame, **tags) -> DataFrame:
    """Constant or computed columns named with an underscore: where a row comes from."""
    return df.withColumns({f"_{k}": v if isinstance(v, Column) else F.lit(v) for k, v in tags.items()}) if tags else df


def full_text(title: Column, body: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def submission_of(link_id: Column, fallback: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(link_id, F.lit("")), fallback), "^t3_", "")


def parent_comment(parent_id: Column) -> Column:
    return F.when(parent_id.startswith("t1_"), parent_id.substr(4, 1 << 20))


def region(c: Column, names=REGION_COMMUNITIES, inside: str = "Venezuela", outside: str = "US/English") -> Column:
    return F.when(F.lower(c).isin(names), inside).otherwise(outside)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isNotNull(), "Fall")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def log_clip(x: Column) -> Column:
    return F.log10(F.greatest(x.cast("double"), F.lit(1.0)))


def signed_score(label: Column, confidence: Column) -> Column:
    low = F.lower(label)
    return F.when(F.contains(low, F.lit("pos")), confidence).when(F.contains(low, F.lit("neg")), -confidence).otherwise(0.0)


def sentiment_bucket(score: Column, cut: float = 0.2) -> Column:
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts), F.lit("Q"), F.quarter(ts))


def period_label(ts: Column, granularity: str = "month") -> Column:
    return {"month": F.date_format(ts, "yyyy-MM"), "quarter": quarter_label(ts), "year": F.date_format(ts, "yyyy")}[granularity]


def cluster_label(cluster: Column, community: Column, n: Column) -> Column:
    return F.format_string("C%d (r/%s, n=%d)", cluster, community, n)
