"""Temporal URL lists: dated entries become validity intervals, captures are judged as of fetch time.

A list is a table of dated changes (list_name, pattern, effective, action):
from `effective` on, the pattern (a host; it covers its subdomains too) is on
the list (`add`) or off it (`remove`). Consecutive changes of one pattern on
one list give half-open intervals [valid_from, valid_to). A capture is blocked
by a list if, at its fetch time, an interval that ends with no removal covers
its host or one of its parent domains; the most specific pattern decides, then
the list's name.

Scale: the judged unit is the distinct (host, fetch time), counted map-side,
so a host with a third of all captures is judged once per time. Intervals and
captures meet on (pattern, 32-day bucket), which bounds what one key holds and
keeps the range test inside small groups; the hash join's build side is the
list. Only built-in functions are used.

Defined results: rows with a null or hostless URL, or no fetch time, are
allowed with reason `no host` / `no time`; rows repeated in the input stay
repeated; changes of one pattern at one instant: `remove` wins; changes with a
null in any field are void; without captures or changes the result is empty or
allows everything. All other columns of the captures are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BUCKET_DAYS = 32
FOREVER = "9999-12-31 00:00:00"


def host_of(url) -> F.Column:
    """Lower-case host without user, port and a final dot, an IPv6 address in its brackets; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def suffixes(host) -> F.Column:
    """The host and its parents down to two labels, longest first; an address has no parents."""
    parts = F.split(host, r"\.")
    names = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    return F.when(host.rlike(r"^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.array(host)).otherwise(names)


def intervals(changes: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to) in which a pattern is on a list."""
    c = changes.select("list_name", F.lower("pattern").alias("pattern"), "effective", "action").dropna()
    at_once = c.groupBy("list_name", "pattern", "effective").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list_name", "pattern").orderBy("effective")
    spans = at_once.withColumn("valid_to", F.lead("effective").over(w))
    return spans.filter("action = 'add'").select(
        "list_name", "pattern", F.col("effective").alias("valid_from"), F.coalesce("valid_to", F.lit(FOREVER).cast("timestamp")).alias("valid_to")
    )


def bucket(ts) -> F.Column:
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)


def judge(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Captures with host, blocked, list_name, pattern, valid_from and reason."""
    names = ["host", "blocked", "list_name", "pattern", "valid_from", "reason"]
    # the join key is the pair of host and time; extra columns, names clashing or not, ride along in a struct
    c = captures.select(F.struct(*[F.col(f"`{x}`") for x in captures.columns]).alias("_row"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("_at"))
    keys = c.select("host", "_at").dropna().distinct()
    asked = keys.select("host", "_at", F.posexplode(suffixes(F.col("host"))).alias("depth", "pattern"), bucket(F.col("_at")).alias("b"))
    reach = keys.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    spans = (
        intervals(changes).crossJoin(F.broadcast(reach))  # one row
        .filter("valid_from <= hi and valid_to > lo")
        .withColumn("b", F.explode(F.sequence(bucket(F.greatest("valid_from", "lo")), bucket(F.least("valid_to", "hi")))))
        .drop("lo", "hi")
    )
    hits = (
        asked.join(spans.hint("shuffle_hash"), ["pattern", "b"])
        .filter("_at >= valid_from and _at < valid_to")
        .groupBy("host", "_at")
        .agg(F.min(F.struct("depth", "list_name", "pattern", "valid_from")).alias("hit"))
    )
    j = c.join(hits.withColumnsRenamed({"host": "h", "_at": "t"}).hint("shuffle_hash"), (F.col("host") == F.col("h")) & (F.col("_at") == F.col("t")), "left")
    out = j.select(
        *[F.col("_row").getField(x).alias(x) for x in captures.columns if x not in names],
        "host",
        F.col("hit").isNotNull().alias("blocked"),
        "hit.list_name", "hit.pattern", "hit.valid_from",
        F.when(F.col("host").isNull(), "no host").when(F.col("_at").isNull(), "no time").when(F.col("hit").isNull(), "not listed").otherwise("listed").alias("reason"),
    )
    return out


def number(text, n: int) -> F.Column:
    """A number under n that the text decides, the same in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: a minute in the 360 days from 2024-01-01 on that page_id and URL decide."""
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("url", F.lit("")))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + 60 * number(key, 518400)).alias("fetched"))


def changes_of(pages: DataFrame) -> DataFrame:
    """Dated changes for the hosts and parent domains that occur in pages.

    Each of two lists adds about a third of the names at a day of their own,
    drops half of those again 20 to 179 days later, and adds half of the
    dropped ones anew 30 days after that.
    """
    names = pages.select(F.explode(suffixes(host_of(F.col("url")))).alias("pattern")).distinct()
    lists = names.select("pattern", F.explode(F.array(F.lit("malware"), F.lit("spam"))).alias("list_name"))
    k = F.concat("list_name", F.lit("|"), "pattern")
    lists = lists.select("list_name", "pattern", number(F.concat(k, F.lit("|use")), 12).alias("u"), number(F.concat(k, F.lit("|from")), 300).alias("d"), number(F.concat(k, F.lit("|for")), 160).alias("n"))
    at = lambda days: F.timestamp_seconds(F.lit(1704067200) + 86400 * days)
    one = lambda when, action, days: F.when(when, F.struct(at(days).alias("effective"), F.lit(action).alias("action")))
    steps = F.array_compact(F.array(
        one(F.col("u") < 4, "add", F.col("d")),
        one(F.col("u") < 2, "remove", F.col("d") + 20 + F.col("n")),
        one(F.col("u") < 1, "add", F.col("d") + 50 + F.col("n")),
    ))
    return lists.select("list_name", "pattern", F.inline(steps))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, against lists made of the hosts in the pages."""
    pages = table(spark, sf_dir, "pages")
    changes = written(changes_of(pages), "changes")
    return judge(captures_of(pages), changes).select("page_id", "url", "fetched", "host", "blocked", "list_name", "pattern", "valid_from", "reason")


SQL = r"""
WITH n0 AS (
  SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@]+)', 1), '\.+$', ''), '') AS host,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST('0x' || substr(md5(concat(coalesce(CAST(page_id AS VARCHAR), ''), '|', coalesce(url, ''))), 1, 8) AS BIGINT) % 518400) AS fetched
  FROM pages
), c AS (
  SELECT row_number() OVER () AS rid, *, CASE WHEN regexp_matches(host, '^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$') THEN [host] ELSE string_split(host, '.') END AS parts FROM n0
), s AS (
  SELECT rid, page_id, fetched, i - 1 AS depth, array_to_string(parts[i:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS i FROM c WHERE host IS NOT NULL)
), names AS (SELECT DISTINCT pattern FROM s),
l AS (
  SELECT list_name, pattern,
    CAST('0x' || substr(md5(list_name || '|' || pattern || '|use'), 1, 8) AS BIGINT) % 12 AS u,
    CAST('0x' || substr(md5(list_name || '|' || pattern || '|from'), 1, 8) AS BIGINT) % 300 AS d,
    CAST('0x' || substr(md5(list_name || '|' || pattern || '|for'), 1, 8) AS BIGINT) % 160 AS n
  FROM names, (VALUES ('malware'), ('spam')) v(list_name)
), ch AS (
  SELECT list_name, pattern, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT)) AS effective, 'add' AS action FROM l WHERE u < 4
  UNION ALL SELECT list_name, pattern, TIMESTAMP '2024-01-01' + to_days(CAST(d + 20 + n AS INT)), 'remove' FROM l WHERE u < 2
  UNION ALL SELECT list_name, pattern, TIMESTAMP '2024-01-01' + to_days(CAST(d + 50 + n AS INT)), 'add' FROM l WHERE u < 1
), per_list AS (SELECT s.rid, s.depth, s.fetched, v.list_name, s.pattern FROM s, (VALUES ('malware'), ('spam')) v(list_name)
), latest AS (
  SELECT p.rid, p.depth, p.list_name, p.pattern, ch.effective, ch.action
  FROM per_list p ASOF JOIN ch ON p.list_name = ch.list_name AND p.pattern = ch.pattern AND p.fetched >= ch.effective
), hit AS (
  SELECT rid, list_name, pattern, effective AS valid_from FROM latest WHERE action = 'add'
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY depth, list_name) = 1
)
SELECT c.page_id, c.url, c.fetched, c.host, hit.rid IS NOT NULL AS blocked, hit.list_name, hit.pattern, hit.valid_from,
  CASE WHEN c.host IS NULL THEN 'no host' WHEN hit.rid IS NULL THEN 'not listed' ELSE 'listed' END AS reason
FROM c LEFT JOIN hit ON c.rid = hit.rid
"""
