"""Queries on state that earlier rows left: the chain of caches, values as of a time, and what worked for similar questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import expansion as x
from corpusloom.operators.bibliometrics import ranked_prefix
from corpusloom.operators.fallback import Times, answer_levels
from corpusloom.operators.landmarks import landmarks
from corpusloom.operators.scans import asof
from corpusloom.sources.tables import load, load_events

TIMES = Times(memory=7200, disk=86_400, pause=(60, 900), failure=(600, 7200))


def fallback_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that answers each view and click: sign-ups write memory and disk, purchases the disk alone (bare lists under 50, else in an envelope of
    version 2, of 3 beyond 150), errors are refusals. A click that reaches the network fails."""
    ev = load_events(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), "event_type", "value")
    requests = ev.filter(F.col("event_type").isin("view", "click")).select(F.col("event_id").alias("request"), "key", "at", (F.col("event_id") * 2).alias("place"), F.when(F.col("event_type") == "view", "ok").otherwise("error").alias("outcome"))
    memory = ev.filter("event_type = 'signup'").select("key", "at", (F.col("event_id") * 2).alias("place"), F.lit("memory").alias("store"), F.lit(2).alias("version"))
    version = F.when(F.col("event_type") == "signup", 2).when(F.col("value") < 50, 1).when(F.col("value") < 150, 2).otherwise(3)
    disk = ev.filter(F.col("event_type").isin("signup", "purchase")).select("key", "at", (F.col("event_id") * 2 + 1).alias("place"), F.lit("disk").alias("store"), version.alias("version"))
    refusals = ev.filter("event_type = 'error'").select("key", "at", (F.col("event_id") * 2).alias("place"), (F.col("value") * 10).alias("seconds"))
    return answer_levels(requests, memory.unionByName(disk), refusals, TIMES)


def asof_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment and city that each sale's client had when it was sold, by the client's last change until then."""
    sales = load(spark, sf_dir, "sales").filter("client_id IS NOT NULL AND sold_at IS NOT NULL")
    sales = sales.groupBy("sale_id", "client_id", "sold_at").agg(F.count("*").alias("n_rows"))
    sales = sales.select("sale_id", "client_id", F.col("sold_at").alias("at"), "n_rows", F.struct("sale_id", "sold_at").alias("place"))
    changes = load(spark, sf_dir, "client_changes").filter("client_id IS NOT NULL AND valid_at IS NOT NULL")
    order = F.struct(F.coalesce("change_id", F.lit(-1)).alias("sale_id"), F.col("valid_at").alias("sold_at"))
    once = changes.groupBy("client_id", F.col("valid_at").alias("at"), order.alias("place")).agg(F.max(F.struct("segment", "city", "op")).alias("c"))
    found = asof(sales, once.select("client_id", "at", "place", "c.*"), "client_id", "at", ["segment", "city", "op"], "place")
    return found.select("sale_id", "client_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("sold_at"), "n_rows", "segment", "city", "op")


def similar_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the titles of every twentieth document, what worked for similar other ones: their second lines, scored by their share of both lines."""
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n", 3).alias("ls")).filter("size(ls) > 0")
    rows = lines.select("id", F.col("ls")[0].alias("query"), F.get("ls", F.lit(1)).alias("expansion"))
    size = F.length("expansion") / (F.length("query") + F.length("expansion"))
    history = rows.filter("length(expansion) > 0").select("id", "query", "expansion", F.round(size, 6).alias("score"))
    found = x.similar_successes(rows.filter("id % 20 = 0").select("id", "query"), history, 3)
    return found.select("id", "rank", F.md5("expansion").alias("expansion_md5"), "value")


def topic_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated documents of each question's first word: by the first words of titles, the five longest documents of each."""
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("place"), F.split("text", "\n")[0].alias("title"), F.length("text").alias("size"))
    first = lambda c: F.lower(F.trim(F.split(c, " ")[0]))
    keyed = docs.select("place", "title", "size", first("title").alias("key")).filter("key <> ''")
    records = ranked_prefix(keyed, ["key"], [F.desc("size"), F.col("place")], 5).select("key", "place", "title", F.round(F.length("title") / 1000, 6).alias("score"))
    turns = load(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("topic_id"), F.split("text", " ")[0].alias("topic"))
    found = landmarks(turns, records)
    return found.select("topic_id", "id", F.md5("title").alias("title_md5"), "citations")


QUERIES = {"topic_landmarks": topic_landmarks, "fallback_levels": fallback_levels, "asof_changes": asof_changes, "similar_successes": similar_successes}

_UNTIL = "tm + CAST(round(least(greatest(value * 10, {0}), {1}) * 1000000) AS BIGINT)"
ORACLES = {
    "topic_landmarks": """WITH d AS (SELECT doc_id AS place, string_split(text, chr(10))[1] AS title, length(text) AS size FROM documents WHERE text IS NOT NULL), k AS (SELECT *, lower(trim(string_split(title, ' ')[1], ' ')) AS key FROM d),
        r AS (SELECT key, place, title, round(length(title) / 1000, 6) AS score FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY size DESC, place) <= 5), ks AS (SELECT key, min(place) AS place FROM r GROUP BY key),
        t AS (SELECT conv_id * 100 + turn AS topic_id, lower(trim(coalesce(string_split(text, ' ')[1], ''), ' ')) AS name FROM conversations WHERE role = 'user'), n AS (SELECT DISTINCT name FROM t),
        b AS (SELECT name, first(key ORDER BY CAST(key <> name AS INT), place) AS key FROM n JOIN ks ON contains(key, name) OR contains(name, key) GROUP BY name),
        l AS (SELECT topic_id, t.name, title, score, row_number() OVER (PARTITION BY topic_id ORDER BY place) AS i FROM t JOIN b ON t.name = b.name JOIN r ON r.key = b.key)
        SELECT topic_id, 'local-' || replace(name, ' ', '-') || '-' || i AS id, md5(title) AS title_md5, CAST(floor(2000 * score + 1000) AS BIGINT) AS citations FROM l""",
    "fallback_levels": f"""WITH e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS tm, event_type AS t, value FROM events),
        r AS (SELECT event_id, key, tm, event_id * 2 AS place, t, NULL::BIGINT AS mem, NULL::BIGINT AS disk_at, NULL::INT AS version, NULL::BIGINT AS fail, NULL::BIGINT AS pause FROM e WHERE t IN ('view', 'click')
          UNION ALL SELECT NULL, key, tm, event_id * 2, t, tm, NULL, NULL, NULL, NULL FROM e WHERE t = 'signup'
          UNION ALL SELECT NULL, key, tm, event_id * 2 + 1, t, NULL, tm, CASE WHEN t = 'signup' THEN 2 WHEN value < 50 THEN 1 WHEN value < 150 THEN 2 ELSE 3 END, NULL, NULL FROM e WHERE t IN ('signup', 'purchase')
          UNION ALL SELECT NULL, key, tm, event_id * 2, t, NULL, NULL, NULL, {_UNTIL.format(*TIMES.failure)}, {_UNTIL.format(*TIMES.pause)} FROM e WHERE t = 'error'),
        s AS (SELECT event_id, tm, t, last_value(mem IGNORE NULLS) OVER k AS mem, last_value(disk_at IGNORE NULLS) OVER k AS disk_at, last_value(version IGNORE NULLS) OVER k AS version, last_value(fail IGNORE NULLS) OVER k AS fail,
          max(pause) OVER (ORDER BY tm, place ROWS UNBOUNDED PRECEDING) AS pause FROM r WINDOW k AS (PARTITION BY key ORDER BY tm, place ROWS UNBOUNDED PRECEDING)),
        f AS (SELECT *, coalesce(version = 1 OR (version = 2 AND tm - disk_at <= {TIMES.disk * 1000000}), false) AS on_disk FROM s WHERE event_id IS NOT NULL)
        SELECT event_id AS request, CASE WHEN tm < pause AND on_disk THEN 'disk_while_paused' WHEN tm < pause THEN 'paused' WHEN tm - mem <= {TIMES.memory * 1000000} THEN 'memory' WHEN on_disk THEN 'disk' WHEN tm < fail THEN 'remembered_refusal' WHEN t = 'view' THEN 'network' ELSE 'error' END AS level FROM f""",
    "asof_changes": """WITH s AS (SELECT sale_id, client_id, sold_at, count(*) AS n_rows FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL),
        c AS (SELECT client_id, valid_at, coalesce(change_id, -1) AS place, max({'segment': segment, 'city': city, 'op': op}) AS c FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY ALL),
        l AS (SELECT client_id, valid_at, max_by(c, place) AS c FROM c GROUP BY ALL)
        SELECT s.sale_id, s.client_id, strftime(s.sold_at, '%Y-%m-%d %H:%M:%S.%f') AS sold_at, n_rows, c.segment, c.city, c.op FROM s ASOF LEFT JOIN l ON s.client_id = l.client_id AND s.sold_at >= l.valid_at""",
    "similar_successes": """WITH d AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), r AS (SELECT id, ls[1] AS query, ls[2] AS expansion FROM d),
        w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '')) AS ws FROM r),
        h AS (SELECT id AS h, query, list_sort(ws) AS hs, expansion, round(length(expansion) / (length(query) + length(expansion)), 6) AS score FROM w WHERE length(expansion) > 0 AND len(ws) > 0),
        p AS (SELECT w.id, h.h, h.expansion, score, len(list_intersect(ws, hs)) / greatest(len(ws), len(hs)) AS sim FROM w, h WHERE w.id % 20 = 0 AND w.id <> h.h),
        v AS (SELECT id, h, expansion, round(score * sim, 6) AS value FROM p WHERE sim > 0.5)
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY value DESC, h) AS INTEGER) AS rank, md5(expansion) AS expansion_md5, value FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY value DESC, h) <= 3""".replace("        b AS (SELECT hs, min(h) AS h FROM h GROUP BY hs),\n", ""),
}
