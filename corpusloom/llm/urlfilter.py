"""URL filters by a temporal list join.

A list is a table of dated entries (domain, action, listed_at). Each entry holds from
its date until the next entry of the same domain, which gives validity intervals. A
capture is matched with its host and every parent domain, as of its fetch time, and
the most specific domain with a ``block`` or ``allow`` entry in force decides; ``drop``
ends an entry without a successor. Intervals of a domain do not overlap, so a capture
meets at most one entry of each of its domains.

The joins are on the domain alone with a range condition: a hot host's captures are
split by the engine's skew join, since the list side is small for each domain.

Defined cases: a null url, or one without a host, is not listed and allowed; a null
fetch time meets no entry; of entries of one domain with the same date the action that
sorts first holds; entries with nulls are ignored; repeated captures are each
judged; an empty list allows everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """domain, action, valid_from, valid_to (null: still in force) of the entries."""
    clean = entries.filter("domain is not null and action is not null and listed_at is not null").groupBy(F.lower("domain").alias("domain"), "listed_at").agg(F.min("action").alias("action"))
    order = Window.partitionBy("domain").orderBy("listed_at")
    dated = clean.select("domain", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(order).alias("valid_to"))
    return dated.filter("action in ('block', 'allow')")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, host, list_domain, valid_from, blocked for every capture."""
    hosts = captures.select("page_id", "url", "fetched_at").withColumn("host", F.lower(F.regexp_extract("url", HOST, 1)))
    counted = hosts.groupBy("page_id", "url", "fetched_at", "host").agg(F.count("*").alias("__copies"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = counted.filter("host is not null and host <> '' and fetched_at is not null").withColumn("domain", F.explode(domains))
    listed = intervals(entries)
    met = probes.join(listed, (probes.domain == listed.domain) & (probes.fetched_at >= listed.valid_from) & (listed.valid_to.isNull() | (probes.fetched_at < listed.valid_to)))
    best = met.groupBy("page_id", "url", "fetched_at").agg(F.max(F.struct(F.length(probes.domain).alias("n"), probes.domain.alias("list_domain"), "action", "valid_from")).alias("best"))
    best = best.select(F.col("page_id").alias("__p"), F.col("url").alias("__u"), F.col("fetched_at").alias("__f"), "best")
    out = counted.join(best, counted.page_id.eqNullSafe(F.col("__p")) & (counted.url == F.col("__u")) & (counted.fetched_at == F.col("__f")), "left")
    return out.select(
        "page_id", "url", "fetched_at", "host", F.col("best.list_domain").alias("list_domain"), F.col("best.valid_from").alias("valid_from"),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"), F.explode(F.expr("array_repeat(0, cast(__copies as int))")).alias("__again")).drop("__again")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; the tables hold no fetch time, so page_id gives one within 60 days."""
    return pages.select("page_id", "url", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast((page_id * 37) % 86400 as int), 0)").alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of the hosts themselves: a hash of the host says when it is blocked and when it is let go."""
    hosts = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("domain")).filter("domain <> ''").distinct()
    code = hosts.withColumn("h", F.md5("domain"))
    day = lambda a: F.expr(f"timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(conv(substring(h, {a}, 2), 16, 10) as int) % 30, 0, 0, 0)")
    later = lambda a: F.expr(f"timestamp '2024-01-31 00:00:00' + make_interval(0, 0, 0, cast(conv(substring(h, {a}, 2), 16, 10) as int) % 30, 0, 0, 0)")
    first = code.filter("substring(h, 1, 1) < 'c'").select("domain", F.lit("block").alias("action"), day(3).alias("listed_at"))
    ended = code.filter("substring(h, 2, 1) < '8'").select("domain", F.expr("case when substring(h, 2, 1) < '4' then 'drop' else 'allow' end").alias("action"), later(5).alias("listed_at"))
    return first.unionByName(ended)


ORACLE = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((page_id * 37) % 86400 AS INT)) AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host
  FROM pages),
codes AS (SELECT DISTINCT host AS domain, md5(host) AS h FROM captures WHERE host <> ''),
entries AS (
  SELECT domain, 'block' AS action, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(('0x' || substr(h, 3, 2)) AS INT) % 30) AS listed_at
  FROM codes WHERE substr(h, 1, 1) < 'c'
  UNION ALL
  SELECT domain, CASE WHEN substr(h, 2, 1) < '4' THEN 'drop' ELSE 'allow' END,
         TIMESTAMP '2024-01-31 00:00:00' + to_days(CAST(('0x' || substr(h, 5, 2)) AS INT) % 30)
  FROM codes WHERE substr(h, 2, 1) < '8'),
dated AS (SELECT domain, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY domain ORDER BY listed_at) AS valid_to FROM entries)
SELECT page_id, url, CAST(fetched_at AS VARCHAR) AS fetched_at, host, domain AS list_domain, CAST(valid_from AS VARCHAR) AS valid_from, coalesce(action = 'block', false) AS blocked
FROM captures LEFT JOIN dated ON host = domain AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) AND action IN ('block', 'allow')
"""
