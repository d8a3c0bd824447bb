"""URL filters by a temporal list join, in DataFrame expressions only.

A list is a table of dated entries (pattern, action, listed_on): from that day on the pattern is
blocked, allowed, or (action ``remove``) off the list. Entries of a pattern become validity
intervals, each ending where the pattern's next one begins. A capture is evaluated against the
entries active on the day it was fetched: the as-of join looks up its host and all parent domains.
The longest active pattern decides; a capture that none matches is kept.

Captures of one host on one day share a verdict, so (host, day) pairs are evaluated once and
joined back. That spreads a hot host over its days; what is left of its weight is split by the
adaptive skew join. Parent domains that the list doesn't have (a top-level domain that all hosts share,
say) are dropped before the shuffle as long as the list's patterns number ``FEW`` at most.

Defined results: a null or hostless url has a null host, matches nothing and is kept; a capture
without a day is kept too (nothing is known to be active). Of entries of one pattern on one day
``block`` wins over ``allow``, and that over ``remove``. Entries with a null pattern or day are
ignored. Repeated captures are repeated in the result;
empty tables give empty results (no list: everything is kept). Very long urls are one value each, their
host's parents an array of it. Clashing column names do no harm: only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.runtime import materialize

#: Patterns up to which the list's are broadcast to drop domains that it doesn't have.
FEW = 500_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; null where there is none."""
    rest = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    host = F.regexp_replace(F.lower(rest), r"\.+$", "")
    return F.when(host != "", host)


def parents(host: Column) -> Column:
    """The host and each parent domain."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to): one row for each stretch with a pattern on the list."""
    strength = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    daily = (
        entries.where("pattern is not null and listed_on is not null")
        .groupBy(F.lower("pattern").alias("pattern"), "listed_on")
        .agg(F.max_by("action", strength).alias("action"))
    )
    order = Window.partitionBy("pattern").orderBy("listed_on")
    spans = daily.select("pattern", "action", F.col("listed_on").alias("valid_from"), F.lead("listed_on").over(order).alias("valid_to"))
    return spans.where(F.col("action").isin("block", "allow"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, n_active, pattern, action, kept for captures (page_id, url, fetched_on)."""
    own = materialize(captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_on"), "captures")
    spans = materialize(intervals(entries), "intervals")
    patterns = spans.select("pattern").distinct()
    asked = own.where("host is not null and fetched_on is not null").select("host", "fetched_on").distinct()
    looked_up = asked.select("host", "fetched_on", F.explode(parents(F.col("host"))).alias("pattern"))
    if patterns.limit(FEW + 1).count() <= FEW:
        looked_up = looked_up.join(F.broadcast(patterns), "pattern", "left_semi")
    active = looked_up.join(spans, "pattern").where("fetched_on >= valid_from and (valid_to is null or fetched_on < valid_to)")
    verdicts = active.groupBy("host", "fetched_on").agg(
        F.count("*").alias("n_active"),
        F.max_by(F.struct("pattern", "action"), F.length("pattern")).alias("best"),
    )
    return own.join(verdicts, ["host", "fetched_on"], "left").select(
        "page_id",
        "host",
        "fetched_on",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.action").alias("action"),
        F.coalesce(F.col("best.action") != "block", F.lit(True)).alias("kept"),
    )


def demonstration_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch day; it is set by rule: day page_id mod 366 of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched_on"))


def demonstration_entries(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the hosts: a third are blocked on a day set by the md5 of the
    host, half of those are taken off 90 days later, and their parent domain is allowed or blocked."""
    hosts = materialize(pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct(), "hosts")
    digit = lambda c, k: F.conv(F.substring(F.md5(c), k, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    listed = hosts.where(digit(F.col("host"), 1) % 3 == 0)
    on = digit(F.col("host"), 3)
    first = listed.select(F.col("host").alias("pattern"), F.lit("block").alias("action"), day(on).alias("listed_on"))
    off = listed.where(digit(F.col("host"), 5) % 2 == 0).select(F.col("host").alias("pattern"), F.lit("remove").alias("action"), day(on + 90).alias("listed_on"))
    parent = hosts.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("pattern")).where("instr(pattern, '.') > 0").distinct()
    above = parent.select("pattern", F.when(digit(F.col("pattern"), 1) % 2 == 0, "allow").otherwise("block").alias("action"), day(digit(F.col("pattern"), 3)).alias("listed_on"))
    return first.unionByName(off).unionByName(above)


ORACLE = r"""
WITH own AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '\.+$', ''), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on
  FROM pages),
hosts AS (SELECT DISTINCT host FROM own WHERE host IS NOT NULL),
listed AS (SELECT host, CAST('0x' || substr(md5(host), 3, 2) AS INTEGER) AS d FROM hosts WHERE CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) % 3 = 0),
above AS (SELECT DISTINCT regexp_replace(host, '^[^.]+\.', '') AS pattern FROM hosts),
entries AS (
  SELECT host AS pattern, 'block' AS action, 2 AS strength, CAST(DATE '2024-01-01' + d AS DATE) AS listed_on FROM listed
  UNION ALL SELECT host, 'remove', 0, CAST(DATE '2024-01-01' + (d + 90) AS DATE) FROM listed WHERE CAST('0x' || substr(md5(host), 5, 2) AS INTEGER) % 2 = 0
  UNION ALL SELECT pattern, CASE WHEN CAST('0x' || substr(md5(pattern), 1, 2) AS INTEGER) % 2 = 0 THEN 'allow' ELSE 'block' END,
    CASE WHEN CAST('0x' || substr(md5(pattern), 1, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE 2 END,
    CAST(DATE '2024-01-01' + CAST('0x' || substr(md5(pattern), 3, 2) AS INTEGER) AS DATE) FROM above WHERE pattern LIKE '%.%'),
daily AS (SELECT pattern, listed_on, arg_max(action, strength) AS action FROM entries GROUP BY ALL),
spans AS (SELECT pattern, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS valid_to FROM daily),
active AS (
  SELECT o.page_id, s.pattern, s.action FROM own o JOIN spans s
  ON (o.host = s.pattern OR ends_with(o.host, '.' || s.pattern)) AND s.action <> 'remove' AND o.fetched_on >= s.valid_from AND (s.valid_to IS NULL OR o.fetched_on < s.valid_to)),
best AS (SELECT page_id, count(*) AS n_active, arg_max(pattern, length(pattern)) AS pattern, arg_max(action, length(pattern)) AS action FROM active GROUP BY page_id)
SELECT o.page_id, o.host, o.fetched_on, CAST(coalesce(b.n_active, 0) AS BIGINT) AS n_active, b.pattern, b.action, coalesce(b.action <> 'block', TRUE) AS kept
FROM own o LEFT JOIN best b USING (page_id)
"""
