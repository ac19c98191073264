"""Operator 1: URL filtering by a temporal list join.

A list is dated entries: a host or a parent domain is added or removed on a day.
Entries of one pattern become validity intervals, from each addition up to the
next entry. A capture is judged by the entries that were active when it was
fetched: of those whose pattern is its host or a parent of it, the longest.

Only distinct pairs of host and fetch day meet the list, each with its parent
domains; a host that a third of all captures share counts once a day. Intervals
and pairs meet by pattern and span of days, so that neither a pattern under which
every host falls nor a long history lands in one task. Verdicts go back to
captures by host and day. All of it is built-in expressions.

Several entries of a pattern on one day: a removal wins. A capture without a URL,
a host or a day is unlisted; one without an id is kept like any other. Repeated
rows each get a row, and columns beside those named are pruned. An empty list
blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldscape.llm.common import table

#: Days that share a join key.
SPAN_DAYS = 32
FIRST_DAY, DAYS = "2024-01-01", 731


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since and until (exclusive; null: still active) from entries (pattern, day, action: add or remove)."""
    daily = (
        entries.where("pattern is not null and day is not null and action in ('add', 'remove')")
        .groupBy(F.lower("pattern").alias("pattern"), F.col("day").cast("date").alias("day")).agg(F.max("action").alias("action"))
    )
    later = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return daily.select("pattern", F.col("day").alias("since"), later.alias("until"), "action").where("action = 'add'").drop("action")


def temporal_list_join(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched, pattern and since (of the entry that blocks) and blocked, for captures (page_id, url, fetched)."""
    span = lambda day: F.floor(F.datediff(day, F.lit(FIRST_DAY).cast("date")) / SPAN_DAYS)
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    pairs = seen.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    last = pairs.agg(F.max("fetched")).first()[0]
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pairs.select("host", "fetched", F.explode(parents).alias("pattern"), span(F.col("fetched")).alias("span"))
    end = F.least(F.date_sub(F.coalesce("until", F.date_add(F.lit(last), 1)), 1), F.lit(last))
    valid = intervals(entries).where(F.col("since") <= F.lit(last)).withColumn("span", F.explode(F.sequence(span(F.col("since")), span(end))))
    judged = (
        asked.join(valid, ["pattern", "span"]).where("since <= fetched and (until is null or fetched < until)")
        .groupBy("host", "fetched").agg(F.max_by(F.struct("pattern", "since"), F.length("pattern")).alias("by"))
    )
    return seen.join(judged, ["host", "fetched"], "left").select(
        "page_id", "host", "fetched", F.col("by.pattern").alias("pattern"), F.col("by.since").alias("since"), F.col("by").isNotNull().alias("blocked")
    )


def derived_entries(captures: DataFrame) -> DataFrame:
    """A dated list for tables that come with none: three entries for each host and its last two labels, by md5 of the name."""
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(F.array("host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))).alias("pattern")).where("pattern <> ''").distinct()
    each = names.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("#", "pattern", F.col("k").cast("string"))), 1, 7), 16, 10).cast("int")
    return each.select("pattern", F.date_add(F.lit(FIRST_DAY).cast("date"), drawn % DAYS).alias("day"), F.when(F.col("k") == 1, "remove").otherwise("add").alias("action"))


def op1_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has neither fetch days nor a list: both are derived, by arithmetic on page_id and md5 of host names."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    return temporal_list_join(captures, derived_entries(captures)).select(
        "page_id", "host", F.col("fetched").cast("string").alias("fetched"), "pattern", F.col("since").cast("string").alias("since"), "blocked"
    )


SQL = r"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS host,
         DATE '2024-01-01' + CAST(page_id * 7919 % 731 AS INTEGER) AS fetched
  FROM pages
),
names AS (
  SELECT host AS pattern FROM captures WHERE host IS NOT NULL
  UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM captures WHERE host LIKE '%.%'
),
entries AS (
  SELECT pattern, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(pattern || '#' || k), 1, 7) AS BIGINT) % 731 AS INTEGER) AS day,
         max(CASE WHEN k = 1 THEN 'remove' ELSE 'add' END) AS action
  FROM names, range(3) AS r(k) WHERE pattern <> '' GROUP BY ALL
),
standing AS (  -- the last entry of each pattern up to each fetch
  SELECT c.page_id, e.pattern, max(e.day) AS since, arg_max(e.action, e.day) AS action
  FROM captures c JOIN entries e ON e.day <= c.fetched AND (c.host = e.pattern OR ends_with(c.host, '.' || e.pattern))
  GROUP BY ALL
),
judged AS (SELECT page_id, arg_max(pattern, length(pattern)) AS pattern, arg_max(since, length(pattern)) AS since FROM standing WHERE action = 'add' GROUP BY page_id)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, pattern, CAST(since AS VARCHAR) AS since, pattern IS NOT NULL AS blocked
FROM captures LEFT JOIN judged USING (page_id)
"""
