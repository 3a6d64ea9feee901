"""Queries over record views, landmarks, profiles and element chunks, and over usage: limits, gaps, cooldowns and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import cleaning, mathx, text
from corpusloom.operators import bibliometrics as b
from corpusloom.operators import chunking as c
from corpusloom.operators import evidence as e
from corpusloom.operators import views as v
from corpusloom.plans.documents import SENT_SQL, docs, sentences
from corpusloom.plans.records import AS_OF, CITE, RECENT, SPACED
from corpusloom.plans.works import DOCS_SQL, WORKS_SQL, authors, works_docs, works_star
from corpusloom.sources.tables import load, load_events
from corpusloom.streaming import limits

AUTHOR = "R#00000000"


def author_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that an author whose name holds the text, in any case, has written."""
    found = v.by_author(authors(spark, sf_dir), "author", AUTHOR)
    return works_star(spark, sf_dir).join(found, "id", "left_semi").select("id", "title", "citations")


def author_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last names of the first four authors of each work, as record identity compares them."""
    supplier, nation = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    people = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", F.concat_ws(" ", "s_name", "n_name").alias("name"))
    written = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(people, F.col("l_suppkey") == F.col("s_suppkey"))
    listed = written.groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return listed.select("id", F.array_join(F.array_sort(v.surnames(F.col("names"))), ",").alias("surnames"))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the composite of those in English only; the others fall back to their best single score."""
    rows = works_docs(spark, sf_dir).withColumn("recency", mathx.recency(F.col("published_date"), AS_OF)).withColumn("cited", mathx.citation_blended(F.col("citations"), F.col("published_date"), 2024, 0.35))
    return rows.withColumn("density", mathx.share_of(F.col("abstract"), "[0-9]")).withColumn("composite", F.when(F.col("tag") == "en", 0.6 * F.col("cited") + 0.4 * F.col("recency")))


SCORED_SQL = f"""{DOCS_SQL}, sc AS (SELECT *, {RECENT} AS recency, {CITE} AS cited, CASE WHEN length(abstract) > 0 THEN (length(abstract) - length(regexp_replace(abstract, '[0-9]', '', 'g'))) / length(abstract) ELSE 0 END AS density FROM docs),
fb AS (SELECT *, round(CASE WHEN tag = 'en' THEN 0.6 * cited + 0.4 * recency ELSE greatest(density, cited, recency) END, 6) AS final FROM sc)"""


def with_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_docs(spark, sf_dir).withColumn("final", F.round(v.composite(F.col("composite"), F.col("density"), F.col("cited"), F.col("recency")), 6))


def composite_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_final(spark, sf_dir).select("id", "final")


def sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten records of each source by citations, from the newest and from the oldest; the oldest have the least composite first."""
    return v.sorted_views(with_final(spark, sf_dir), ["source"], 10).select("mode", "source", "rank", "id")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of the works' comma lists, uncapped."""
    return works_star(spark, sf_dir).select(F.explode(F.transform(F.split("source", ","), F.trim)).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def landmark_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the landmark of its normalised title, if there is one: titles that several documents share are landmarks."""
    titled = works_docs(spark, sf_dir).select("id", text.title_deleted("title").alias("norm"))
    marks = titled.groupBy("norm").agg(F.min("id").alias("landmark"), F.count("*").alias("seminal")).filter("seminal > 1 and norm <> ''")
    return titled.join(marks, "norm", "left").select("id", "landmark", F.coalesce("seminal", F.lit(0)).alias("seminal"))


def local_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool (records in English) with every record of the other languages whose title is not in it."""
    rows = works_docs(spark, sf_dir).select("id", "tag", text.title_spaced("title").alias("norm"))
    pool, local = rows.filter("tag = 'en'"), rows.filter("tag <> 'en'")
    added = local.join(pool.select(F.col("norm")).distinct(), "norm", "left_anti")
    return pool.select("id", F.lit("pool").alias("path")).unionByName(added.select("id", F.lit("local_landmark").alias("path")))


def chart_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by year, source and language as two-column frames in order."""
    rows = works_docs(spark, sf_dir)
    frames = [rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "key", "n") for name, key in (("year", F.substring("published_date", 1, 4)), ("source", F.col("source")), ("language", F.col("tag")))]
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return b.ranked_prefix(every, ["frame"], [F.col("key")], 1000)


def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of first words by (most, name), without blank names."""
    words = works_docs(spark, sf_dir).select(F.split_part("title", F.lit(" "), F.lit(1)).alias("name"))
    return v.clean_counts(words.groupBy("name").agg(F.count("*").alias("n")), 200)


def results_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chat gets of the eight best records of each source: title and 600 characters of the abstract."""
    best = b.ranked_prefix(with_final(spark, sf_dir), ["source"], [F.desc("final"), F.col("id")], 8)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.substring("abstract", 1, 600))
    return best.groupBy("source").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))), lambda s: s["t"]), "\n\n")).alias("context_md5"), F.count("*").alias("n"))


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text between one heading and the next: the first line of each document's paragraphs that is short heads what follows."""
    return c.by_heading(docs(spark, sf_dir).select("id", "text")).select("id", "section", "heading", F.md5("body").alias("body_md5"))


def overlap_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word chunks that begin with the last ten words of the chunk before."""
    chunks = c.by_words(docs(spark, sf_dir)).select("id", "chunk_no", "chunk")
    return c.with_tail(chunks, 10).select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def element_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table lines and texts of 100 characters or more as typed chunks with key, context of two lines around and embedding text."""
    return c.elements(docs(spark, sf_dir).select("id", "text")).select("id", "kind", "number", "chunk_id", F.md5("context").alias("context_md5"), F.md5("embedding_text").alias("text_md5"))


def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, then sliding windows, then word chunks of every document, equal texts once, the first 40."""
    rows = docs(spark, sf_dir)
    paras = rows.select("id", F.posexplode(c.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("pos", "chunk"))
    parts = [(0, paras), (1, c.sliding(rows).select("id", F.col("chunk_no").alias("pos"), "chunk")), (2, c.by_words(rows).select("id", F.col("chunk_no").alias("pos"), "chunk"))]
    return c.first_chunks(parts, 40).select("id", "rank", "strategy", F.md5("chunk").alias("chunk_md5"))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence sentences of each document, with a denial of testing added, and what is left without those that metrics contradict."""
    own = sentences(spark, sf_dir).select("id", "pos", F.substring("sentence", 1, 160).alias("item"))
    added = docs(spark, sf_dir).select("id", F.lit(-1).cast("long").alias("pos"), F.when(F.col("id") % 2 == 0, "The accuracy was not evaluated.").otherwise("It has not been tested on wikitext.").alias("item"))
    return e.without_contradictions(own.select("id", F.col("pos").cast("long").alias("pos"), "item").unionByName(added), "id").groupBy("id").agg(F.count("*").alias("n_left"), F.min("pos").alias("first_pos"))


def profile_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling sentence of each document, cut at a word to 80 characters."""
    return e.compressed(sentences(spark, sf_dir), "id", 80).select("id", F.md5("evidence").alias("evidence_md5"))


def usage_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with the usage of its user in the minute, day and 30 days before it, the decision and the wait."""
    ev = load_events(spark, sf_dir).select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))
    return limits.usage(ev, limits.Limits(30, 200, 2_000, 6_000)).select("event_id", "tokens_minute", "tokens_day", "tokens_month", "allowed", "reason", "wait")


def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last usage of each user, in hundredths of the limits, and who is beyond 80 of them."""
    ev = load_events(spark, sf_dir).select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))
    return limits.report(ev, limits.Limits(30, 200, 2_000, 6_000))


def request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pause before each event of a type, and what it lacks of an hour."""
    return limits.gaps(load_events(spark, sf_dir), "event_type", 3600.0).select("event_id", "wait")


def cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event falls into the pause that an earlier error of its user began, 600 to 86400 seconds long."""
    return limits.cooldowns(load_events(spark, sf_dir), "user_id", F.col("event_type") == "error", F.col("value") * 3600, 600, 86400).select("event_id", "until", "blocked")


def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a cursor over each source's records: 25 a page, 200 records, six pages at most, and where the cursor stands after each."""
    return v.cursor_pages(works_docs(spark, sf_dir), ["source"], "id", 25, 200, 6)


QUERIES = {
    "author_facet": author_facet, "author_surnames": author_surnames, "composite_fallback": composite_fallback, "sort_modes": sort_modes, "source_counts": source_counts, "landmark_probe": landmark_probe, "local_injection": local_injection,
    "chart_frames": chart_frames, "clean_counts": clean_counts, "results_context": results_context, "section_texts": section_texts, "overlap_tails": overlap_tails, "element_chunks": element_chunks, "chunk_fallback": chunk_fallback,
    "contradictions": contradictions, "profile_compression": profile_compression, "usage_limits": usage_limits, "usage_report": usage_report, "request_gaps": request_gaps, "cooldowns": cooldowns, "cursor_pages": cursor_pages,
}

CHUNKS = """w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
ch AS (SELECT id, unnest(range(0, CAST(ceil(len(ws) / 120.0) AS INT))) AS chunk_no, ws FROM w WHERE len(ws) > 0),
chunks AS (SELECT id, CAST(chunk_no AS INT) AS chunk_no, array_to_string(ws[chunk_no * 120 + 1 : chunk_no * 120 + 150], ' ') AS chunk FROM ch)"""
HEADS = "regexp_matches(trim(line, ' '), '(?i)^(" + "|".join(h.replace(" ", "\\s+") for h in cleaning.SECTION_HEADINGS) + ")$') OR (length(trim(line, ' ')) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(line, ' '), '[.!?:;,]$'))"
USAGE_SQL = """u AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS tokens FROM events),
s AS (SELECT *, count(*) OVER m - 1 AS r, CAST(sum(tokens) OVER m - tokens AS BIGINT) AS tokens_minute, CAST(sum(tokens) OVER d - tokens AS BIGINT) AS tokens_day, CAST(sum(tokens) OVER t - tokens AS BIGINT) AS tokens_month, min(ts) OVER m AS oldest FROM u
  WINDOW m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), t AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))"""
TOKENS = e.DATASET_WORDS
DENIED = "(contains(low, 'not evaluated') OR contains(low, 'not tested') OR contains(low, 'has not been evaluated') OR contains(low, 'has not been tested'))"
METRIC = "(regexp_matches(low, '(^|[^\\p{L}\\p{N}_])\\d[\\d.]*\\s*(%|f1|accuracy|bleu|rouge|auc|map)($|[^\\p{L}\\p{N}_])') OR (regexp_matches(low, '[0-9]') AND (" + " OR ".join(f"contains(low, '{t}')" for t in TOKENS) + ")))"

ORACLES = {
    "author_facet": f"WITH {WORKS_SQL} SELECT id, title, citations FROM works WHERE EXISTS (SELECT 1 FROM auth WHERE l_partkey = id AND contains(lower(s_name), '{AUTHOR.lower()}'))",
    "author_surnames": """WITH p AS (SELECT s_suppkey, concat_ws(' ', s_name, n_name) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), l AS (SELECT l_partkey AS id, list_sort(list_distinct(list(name))) AS ns FROM lineitem JOIN p ON l_suppkey = s_suppkey GROUP BY l_partkey)
        SELECT id, array_to_string(list_sort(list_distinct(list_transform(ns[1:4], lambda n: lower(string_split(n, ' ')[-1])))), ',') AS surnames FROM l""",
    "composite_fallback": f"WITH {SCORED_SQL} SELECT id, final FROM fb",
    "sort_modes": f"""WITH {SCORED_SQL}, r AS (SELECT 'citations' AS mode, source, id, row_number() OVER (PARTITION BY source ORDER BY citations DESC, final DESC, id) AS rank FROM fb UNION ALL SELECT 'newest', source, id, row_number() OVER (PARTITION BY source ORDER BY published_date DESC, final DESC, id) FROM fb
        UNION ALL SELECT 'oldest', source, id, row_number() OVER (PARTITION BY source ORDER BY published_date, final, id) FROM fb) SELECT mode, source, CAST(rank AS INT) AS rank, id FROM r WHERE rank <= 10""",
    "source_counts": f"WITH {WORKS_SQL} SELECT trim(s) AS source, count(*) AS n FROM (SELECT unnest(string_split(source, ',')) AS s FROM works) GROUP BY 1",
    "landmark_probe": f"""WITH {DOCS_SQL}, t AS (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' ') AS norm FROM docs), m AS (SELECT norm, min(id) AS landmark, count(*) AS seminal FROM t WHERE norm <> '' GROUP BY norm HAVING count(*) > 1)
        SELECT id, landmark, coalesce(seminal, 0) AS seminal FROM t LEFT JOIN m USING (norm)""",
    "local_injection": f"""WITH {DOCS_SQL}, t AS (SELECT id, tag, {SPACED.format(c='title')} AS norm FROM docs) SELECT id, 'pool' AS path FROM t WHERE tag = 'en' UNION ALL SELECT id, 'local_landmark' FROM t WHERE tag <> 'en' AND norm NOT IN (SELECT norm FROM t WHERE tag = 'en')""",
    "chart_frames": f"""WITH {DOCS_SQL}, f AS (SELECT 'year' AS frame, substr(published_date, 1, 4) AS key, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM docs GROUP BY ALL UNION ALL SELECT 'language', tag, count(*) FROM docs GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY key) AS INT) AS rank FROM f""",
    "clean_counts": f"""WITH {DOCS_SQL}, c AS (SELECT string_split(title, ' ')[1] AS name, count(*) AS n FROM docs GROUP BY ALL) SELECT name, n, CAST(row_number() OVER (ORDER BY n DESC, lower(name), name) AS INT) AS rank FROM c WHERE trim(name, ' ') <> '' QUALIFY rank <= 200""",
    "results_context": f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY final DESC, id) AS rank FROM fb) SELECT source, md5(string_agg(concat('[', rank, '] ', title, chr(10), substr(abstract, 1, 600)), chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(*) AS n FROM r WHERE rank <= 8 GROUP BY source""",
    "section_texts": f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM documents), h AS (SELECT *, ({HEADS}) AS head FROM l),
        n AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY id ORDER BY ln) AS INT) AS section FROM h), g AS (SELECT id, section, max(CASE WHEN head THEN trim(line, ' ') END) AS heading, string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY ln) AS body FROM n GROUP BY id, section)
        SELECT id, section, heading, md5(trim(body, ' ')) AS body_md5 FROM g WHERE trim(coalesce(body, ''), ' ') <> ''""",
    "overlap_tails": f"""WITH {CHUNKS}, p AS (SELECT *, lag(chunk) OVER (PARTITION BY id ORDER BY chunk_no) AS before FROM chunks) SELECT id, chunk_no, md5(CASE WHEN before IS NULL THEN chunk ELSE array_to_string(string_split(before, ' ')[-10:], ' ') || chr(10) || chr(10) || chunk END) AS chunk_md5 FROM p""",
    "element_chunks": """WITH d AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS ls FROM documents), t AS (SELECT id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM d), f AS (SELECT id, text, ls, min(i) AS i FROM t WHERE contains(ls[i], '|') GROUP BY id, text, ls),
        e AS (SELECT id, 'table' AS kind, 1 AS number, array_to_string(ls[greatest(i - 2, 1) : i + 2], ' ') AS context, 'Table 1' || chr(10) || 'Context: ' || substr(array_to_string(ls[greatest(i - 2, 1) : i + 2], ' '), 1, 300) AS et FROM f
          UNION ALL SELECT id, 'text', 0, substr(text, 1, 500), 'Text' || chr(10) || substr(text, 1, 480) FROM d WHERE length(trim(text, ' ')) >= 100)
        SELECT id, kind, number, substr(md5(concat(id, '_', kind, '_', number)), 1, 16) AS chunk_id, md5(context) AS context_md5, md5(et) AS text_md5 FROM e""",
    "chunk_fallback": f"""WITH {CHUNKS}, p AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 160) AS ps, trim(replace(text, chr(10), chr(10) || chr(10)), ' ') AS whole FROM documents),
        q AS (SELECT id, CASE WHEN len(ps) > 0 THEN ps WHEN whole <> '' THEN [whole] ELSE [] END AS ps FROM p), a AS (SELECT id, 0 AS s, unnest(range(0, len(ps))) AS pos, unnest(ps) AS chunk FROM q),
        sl AS (SELECT doc_id AS id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 900)) AS start FROM documents), sc AS (SELECT id, 1 AS s, start // 900 AS pos, substr(text, start + 1, 1200) AS chunk FROM sl),
        u AS (SELECT * FROM a UNION ALL SELECT * FROM sc WHERE length(chunk) >= 200 UNION ALL SELECT id, 2, chunk_no, chunk FROM chunks), o AS (SELECT id, chunk, min(s * 1000000 + pos) AS spot FROM u GROUP BY id, chunk),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY spot) AS INT) AS rank FROM o) SELECT id, rank, CAST(spot // 1000000 AS INT) AS strategy, md5(chunk) AS chunk_md5 FROM r WHERE rank <= 40""",
    "contradictions": f"""WITH {SENT_SQL}, i AS (SELECT id, CAST(pos AS BIGINT) AS pos, lower(substr(sentence, 1, 160)) AS low FROM sents UNION ALL SELECT doc_id, -1, lower(CASE WHEN doc_id % 2 = 0 THEN 'The accuracy was not evaluated.' ELSE 'It has not been tested on wikitext.' END) FROM documents),
        f AS (SELECT *, {DENIED} AS denied, {METRIC} AS metric FROM i), m AS (SELECT id, {', '.join(f"max(CAST(metric AND contains(low, '{t}') AS INT)) AS h{k}" for k, t in enumerate(TOKENS))}, max(CAST(metric AS INT)) AS any_metric FROM f GROUP BY id)
        SELECT id, count(*) AS n_left, min(pos) AS first_pos FROM f JOIN m USING (id) WHERE NOT (denied AND any_metric = 1 AND ({' OR '.join(f"(contains(low, '{t}') AND h{k} = 1)" for k, t in enumerate(TOKENS))}
          OR (contains(low, 'text classification') AND ({' OR '.join(f'h{TOKENS.index(t)} = 1' for t in ('glue', 'mnli', 'qqp', 'sst'))})))) GROUP BY id""",
    "profile_compression": f"""WITH {SENT_SQL}, b AS (SELECT id, first(sentence ORDER BY CASE WHEN regexp_matches(sentence, '{e.SPECIFIC}') THEN 0 ELSE 1 END, pos) AS s FROM sents GROUP BY id)
        SELECT id, md5(CASE WHEN length(s) > 80 THEN regexp_replace(substr(s, 1, 77), ' [^ ]*$', '') || '…' ELSE s END) AS evidence_md5 FROM b""",
    "usage_limits": f"""WITH {USAGE_SQL}, q AS (SELECT *, (r >= 30 OR tokens_minute + tokens > 200) AND r > 0 AS slow, (tokens_day + tokens > 1800 AND tokens_day >= 1800) AS no_day, (tokens_month + tokens > 5400 AND tokens_month >= 5400) AS no_month FROM s)
        SELECT event_id, tokens_minute, tokens_day, tokens_month, NOT (no_day OR no_month) AS allowed, CASE WHEN no_month THEN 'month' WHEN no_day THEN 'day' WHEN slow AND tokens_minute + tokens > 200 AND r < 30 THEN 'tokens_minute' WHEN slow THEN 'requests_minute' END AS reason,
          CASE WHEN no_day OR no_month THEN -1.0 WHEN slow THEN round(60 - date_diff('microsecond', oldest, ts) / 1000000.0, 6) ELSE 0.0 END AS wait FROM q""",
    "usage_report": f"""WITH {USAGE_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s)
        SELECT user_id, floor((tokens_day + tokens) * 1000 // 2000) / 10 AS day_percent, floor((tokens_month + tokens) * 1000 // 6000) / 10 AS month_percent, (tokens_day + tokens) / 2000 * 100 > 80 AS day_alert, (tokens_month + tokens) / 6000 * 100 > 80 AS month_alert FROM z WHERE back = 1""",
    "request_gaps": """SELECT event_id, round(greatest(3600.0 - coalesce(date_diff('microsecond', lag(ts) OVER w, ts) / 1000000.0, 3600.0), 0.0), 6) AS wait FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
    "cooldowns": """WITH u AS (SELECT *, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN epoch_us(ts) + CAST(round(least(greatest(value * 3600, 600), 86400) * 1000000) AS BIGINT) END AS ends FROM events),
        m AS (SELECT event_id, t, max(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM u) SELECT event_id, until, coalesce(t < until, false) AS blocked FROM m""",
    "cursor_pages": f"""WITH {DOCS_SQL}, r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM docs) SELECT source, CAST((n - 1) // 25 AS INT) AS page, count(*) AS n, CASE WHEN count(*) = 25 THEN max(id) END AS next_cursor FROM r WHERE n <= 200 AND n <= 150 GROUP BY source, (n - 1) // 25""",
}
