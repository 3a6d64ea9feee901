"""Streaming queries over events, run over what is there; the batch result is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import load
from corpusloom.operators import layout
from corpusloom.plans import views
from corpusloom.sources.cursor import SCHEMA, CursorSource
from corpusloom.sources.folders import new_folder
from corpusloom.streaming import limiter, limits, usage, windows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.read_events(spark, f"{sf_dir}/events.parquet")


def stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp(windows.drained(windows.tumbling(events(spark, sf_dir)), "complete"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp(windows.drained(windows.sliding(events(spark, sf_dir)), "complete"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(windows.sessions(events(spark, sf_dir)), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(windows.deduplicated(events(spark, sf_dir)))


def static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return windows.drained(windows.with_users(events(spark, sf_dir), users))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(limiter.limited(events(spark, sf_dir), requests=3, limit=60))


def usage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``usage_limits`` by keyed state: every request with its user's usage in the minute, day and 30 days before it."""
    asked = events(spark, sf_dir).select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))
    return windows.drained(usage.usage(asked, limits.Limits(30, 200, 2_000, 6_000)))


def cooldown_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cooldowns`` by keyed state."""
    return windows.drained(usage.cooldowns(events(spark, sf_dir), "user_id", F.col("event_type") == "error", F.col("value") * 3600, 600, 86400))


def paged(spark: SparkSession, sf_dir: str) -> str:
    """Writes the documents as a provider's pages: 50 in order of doc_id behind a cursor, which is a digest of the page before. The folder."""
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.lit(0).alias("all"))
    rows = layout.numbered(rows, "all", ["id"], {"n": F.lit(True)}).withColumn("page", F.expr("(n - 1) DIV 50"))
    last = rows.agg(F.max("page").alias("last"))
    token = lambda p: F.when(p == 0, "first").otherwise(F.substring(F.md5(p.cast("string")), 1, 12))
    page = F.col("page")
    named = rows.crossJoin(F.broadcast(last)).select("id", "title", token(page).alias("cursor"), F.when(page < F.col("last"), token(page + 1)).alias("next"))
    folder = new_folder(spark, "provider")
    named.repartition("cursor").write.partitionBy("cursor").json(folder)
    return folder


def cursor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that the cursors lead to, with the page it came on, read by a stream in batches of four pages at first."""
    spark.dataSource.register(CursorSource)
    stream = spark.readStream.format("cursor_records").option("client", "corpusloom.sources.cursor.FolderClient").option("location", paged(spark, sf_dir)).option("per_page", 50).option("batch_pages", 4).load()
    folder = new_folder(spark, "stream")
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").start(folder)
    running.processAllAvailable()
    running.stop()
    return spark.read.schema(SCHEMA).parquet(folder).select("id", F.md5("title").alias("title_md5"), "page")


QUERIES = {"stream_tumbling": tumbling, "stream_sliding": sliding, "stream_session": sessions, "stream_dedup": dedup, "stream_static_join": static_join, "rate_limit_state": rate_limit, "usage_state": usage_state, "cooldown_state": cooldown_state, "cursor_stream": cursor_stream}

ORACLES = {
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL",
    "stream_session": """WITH m AS (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
        SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS events FROM m GROUP BY user_id""",
    "stream_dedup": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "rate_limit_state": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CAST(trunc(value) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT user_id, k, event_id, n <= 60 * 0.9 AS allowed, CASE WHEN n <= 60 * 0.9 THEN [{'t': t, 'n': n}] ELSE [] END AS log FROM e WHERE k = 1
          UNION ALL SELECT user_id, k, event_id, allowed, CASE WHEN allowed THEN list_append(live, {'t': t, 'n': n}) ELSE live END FROM
            (SELECT *, len(live) + 1 <= 3 * 0.9 AND coalesce(list_sum(list_transform(live, lambda x: x.n)), 0) + n <= 60 * 0.9 AS allowed FROM
              (SELECT e.user_id, e.k, e.event_id, e.t, e.n, list_filter(r.log, lambda x: x.t >= e.t - 60000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
        SELECT event_id, user_id, allowed FROM r""",
    "usage_state": views.ORACLES["usage_limits"],
    "cooldown_state": views.ORACLES["cooldowns"],
    "cursor_stream": "SELECT doc_id AS id, md5(string_split(text, chr(10))[1]) AS title_md5, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS page FROM documents",
    "stream_static_join": "SELECT event_id, user_id, c_mktsegment AS segment FROM events JOIN customer ON user_id = c_custkey",
}
