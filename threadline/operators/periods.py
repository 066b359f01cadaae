"""Time windows, period tags, gap-filled timelines, and event alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import small


def period_tag(ts: Column, periods: list[tuple[str, str, str]], default: str = "Normal") -> Column:
    """Name of the closed period that holds ts; of several the last. One expression, no shuffle: for up to some twenty periods."""
    out = F.lit(default)
    for name, start, end in periods:
        out = F.when(ts.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), F.lit(name)).otherwise(out)
    return out


def periods_at(ts: Column, periods: list[tuple[str, str, str]]) -> Column:
    """Names of all closed periods that hold ts, in their order: for up to some twenty periods."""
    return F.array_compact(F.array(*[F.when(ts.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), name) for name, start, end in periods]))


def tag_periods(df: DataFrame, periods: DataFrame, ts: str, default: str = "Normal") -> DataFrame:
    """The same for a period table (name, start, end, ord) of any size: rows and periods meet by month.

    Each period is laid out over the months that it touches, so the range test
    runs within a month's periods; of several the largest ord holds.
    """
    month = lambda c: F.trunc(F.to_date(c), "MM")
    spread = periods.withColumn("_m", F.explode(F.sequence(month(F.col("start")), month(F.col("end")), F.expr("interval 1 month"))))
    best = spread.groupBy("_m").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), "name", "start", "end"))).alias("_p"))
    j = df.withColumn("_m", month(F.col(ts))).join(small(best), "_m", "left")
    inside = F.filter("_p", lambda p: (F.col(ts) >= p["start"]) & (F.col(ts) <= p["end"]))
    return j.withColumn("period", F.coalesce(F.try_element_at(inside, F.lit(-1))["name"], F.lit(default))).drop("_m", "_p")


def monthly_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """[window_start, window_end] by months from the start on; the last one ends with `end`."""
    return _windows(spark, start, end, "interval 1 month")


def daily_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    d = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', interval 1 day)) AS window_date")
    return d.select(F.col("window_date").cast("timestamp").alias("window_start"), (F.col("window_date").cast("timestamp") + F.expr("interval 86399 seconds")).alias("window_end"))


def hourly_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Half-open hours; the last is cut at `end`."""
    s = spark.sql(f"SELECT explode(sequence(TIMESTAMP'{start}', TIMESTAMP'{end}' - interval 1 microsecond, interval 1 hour)) AS window_start")
    return s.select("window_start", F.least(F.col("window_start") + F.expr("interval 1 hour"), F.lit(end).cast("timestamp")).alias("window_end"))


def _windows(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    s = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}' - 1, {step})) AS window_start")
    w = Window.orderBy("window_start")  # a row a window
    return s.select("window_start", F.coalesce(F.date_sub(F.lead("window_start").over(w), 1), F.lit(end).cast("date")).alias("window_end"))


def window_counts(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    """(window_start, window_end, n) of windows in whole days, both ends included: rows are counted a day, days meet windows."""
    perday = df.groupBy(F.to_date(ts).alias("_d")).agg(F.count("*").alias("n"))
    days = windows.withColumn("_d", F.explode(F.sequence(F.col("window_start").cast("date"), F.col("window_end").cast("date"))))
    return days.join(perday.hint("shuffle_hash"), "_d").groupBy("window_start", "window_end").agg(F.sum("n").alias("n"))


def gap_filled(counts: DataFrame, key: str, calendar: DataFrame, value: str = "n") -> DataFrame:
    """Every key of the calendar, 0 where nothing was counted."""
    return calendar.join(counts.hint("shuffle_hash"), key, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def timelines(df: DataFrame, windows: list[tuple[str, str, str]], ts: str) -> DataFrame:
    """(window, date, n) for every day of every window, in one job."""
    spark = df.sparkSession
    w = spark.createDataFrame(windows, "window string, start string, end string")
    days = w.select("window", F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))).alias("date"))
    perday = df.groupBy(F.to_date(ts).alias("date")).agg(F.count("*").alias("n"))
    return gap_filled(perday, "date", days).select("window", "date", "n")


def timeline_stats(lines: DataFrame) -> DataFrame:
    """Total, peak with its earliest day, and mean a day, for each window."""
    return lines.groupBy("window").agg(
        F.sum("n").alias("total"), F.max("n").alias("peak"), F.min(F.struct((-F.col("n")).alias("m"), "date"))["date"].alias("peak_date"), F.avg("n").alias("mean_per_day"),
    )


def with_events(lines: DataFrame, events: list[tuple[str, str, str]]) -> DataFrame:
    """Each event with its day's count, 0 without one."""
    e = lines.sparkSession.createDataFrame(events, "window string, day string, event string").withColumn("date", F.col("day").cast("date")).drop("day")
    return e.join(lines.hint("shuffle_hash"), ["window", "date"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def align_events(posts: DataFrame, events: DataFrame, ts: str, text: str, days: int = 7) -> DataFrame:
    """Posts matched to events (event_id, event_ts, keyword): the keyword is in the text, the post within `days` after it.

    Posts and events meet by day, so the interval test stays in a day's events.
    """
    spread = events.withColumn("_d", F.explode(F.sequence(F.to_date("event_ts"), F.date_add(F.to_date("event_ts"), days))))
    j = posts.withColumn("_d", F.to_date(ts)).join(small(spread), "_d")
    late = F.col("event_ts") + F.make_dt_interval(F.lit(days))
    return j.filter((F.col(ts) >= F.col("event_ts")) & (F.col(ts) <= late) & F.contains(F.lower(text), F.lower("keyword"))).drop("_d")
