"""Chunks of documents set as pages: paragraph windows, and the chunker that each language is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking as c
from corpusloom.operators import windows as w
from corpusloom.plans.views import HEADS
from corpusloom.sources.tables import load

TARGET, OVERLAP, PAGE_LINES = 120, 30, 20
STRATEGY = {"en": "custom", "fr": "sections", "de": "sliding"}


def page_text(lines: Column) -> Column:
    """Lines as paragraphs, with a mark before each page of PAGE_LINES."""
    count = F.ceil(F.size(lines) / PAGE_LINES).cast("int")
    page = lambda g: F.concat(F.lit("\n--- Page "), (g + 1).cast("string"), F.lit(" ---\n"), F.array_join(F.slice(lines, g * PAGE_LINES + 1, PAGE_LINES), "\n\n"))
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), page), "")


def paged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "lang", F.split("text", "\n").alias("lines"))
    return docs.select("id", "lang", page_text(F.col("lines")).alias("text"))


def custom_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.custom(paged_docs(spark, sf_dir), TARGET, OVERLAP).select("id", "chunk_no", "chunk_id", F.md5("chunk").alias("chunk_md5"))


def dispatched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 best chunks of each document, by the chunker of its language; other languages are cut at their pages."""
    strategy = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv]), F.coalesce("lang", F.lit(""))), F.lit("pages"))
    docs = paged_docs(spark, sf_dir).select("id", "text", strategy.alias("strategy"))
    return w.dispatched(docs, custom_words=(TARGET, OVERLAP)).select("id", "strategy", "rank", "chunk_no", F.md5("chunk").alias("chunk_md5"))


QUERIES = {"custom_chunks": custom_chunks, "dispatched_chunks": dispatched_chunks}

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_COUNT = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> ''))"
CUSTOM_SQL = f"""ls AS (SELECT doc_id AS id, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
li AS (SELECT id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM ls),
ln AS (SELECT id, i // {PAGE_LINES} + 1 AS page, i, {_STRIP.format('line')} AS p, regexp_matches(line, '{w.SECTION_LINE}') AS head FROM li),
pl AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY id, page ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM ln),
se AS (SELECT id, page, sec, regexp_replace(max(CASE WHEN head THEN p END), '\\s+', ' ', 'g') AS title, coalesce(list(p ORDER BY i) FILTER (NOT head AND p <> ''), []) AS ps FROM pl GROUP BY ALL),
fo AS (SELECT * FROM se WHERE sec > 0 AND len(ps) > 0),
al AS (SELECT id, page, 0 AS sec, 'page' AS title, list(p ORDER BY i) AS ps FROM pl WHERE p <> '' AND (id, page) NOT IN (SELECT (id, page) FROM fo) GROUP BY id, page),
pt AS (SELECT *, list_transform(ps, lambda p: {_COUNT.format('p')}) AS ws FROM (SELECT * FROM fo UNION ALL SELECT * FROM al) WHERE lower(trim(title, ' ')) <> 'references'),
f AS (SELECT id, page, sec, title, ps, ws, 0 AS i, CAST([] AS BIGINT[]) AS op, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[][]) AS done FROM pt
  UNION ALL SELECT id, page, sec, title, ps, ws, i + 1,
    CASE WHEN w > {TARGET * 1.5} THEN op WHEN len(op) > 0 AND n + w > {TARGET} THEN list_append(keep, i) ELSE list_append(op, i) END,
    CASE WHEN w > {TARGET * 1.5} THEN n WHEN len(op) > 0 AND n + w > {TARGET} THEN CAST(list_sum(list_transform(keep, lambda k: ws[k + 1])) AS BIGINT) + w ELSE n + w END,
    CASE WHEN w > {TARGET * 1.5} THEN list_append(done, [CAST(-1 - i AS BIGINT)]) WHEN len(op) > 0 AND n + w > {TARGET} THEN list_append(done, op) ELSE done END
  FROM (SELECT *, CAST(ws[i + 1] AS BIGINT) AS w, op[coalesce(list_min(list_filter(range(1, len(op) + 1), lambda j: list_sum(list_transform(op[j:], lambda k: ws[k + 1])) <= {OVERLAP})), len(op)):] AS keep FROM f WHERE i < len(ws))),
wi AS (SELECT id, page, sec, title, ps, CASE WHEN len(op) > 0 THEN list_append(done, op) ELSE done END AS done FROM f WHERE i = len(ws)),
me AS (SELECT id, page, sec, title, ps, unnest(done) AS m, unnest(range(0, len(done))) AS k FROM wi),
tx AS (SELECT id, page, sec, title, k, CASE WHEN m[1] < 0 THEN list_filter(regexp_split_to_array(ps[-m[1]], '\\s+'), lambda t: t <> '') END AS own, array_to_string(list_transform(m, lambda q: ps[q + 1]), chr(10) || chr(10)) AS joined FROM me),
ex AS (SELECT id, page, sec, title, k, unnest(CASE WHEN own IS NULL THEN [joined] ELSE list_transform(range(0, len(own), {TARGET - OVERLAP}), lambda a: array_to_string(own[a + 1 : a + {TARGET}], ' ')) END) AS chunk,
  unnest(CASE WHEN own IS NULL THEN [0] ELSE range(0, len(own), {TARGET - OVERLAP}) END) AS j FROM tx),
cu AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY page, sec, k, j) AS INTEGER) AS chunk_no, page, title, chunk FROM ex)"""
_PAGES = f"array_to_string(list_transform(range(0, CAST(ceil(len(ls) / {PAGE_LINES}.0) AS INT)), lambda g: chr(10) || '--- Page ' || (g + 1) || ' ---' || chr(10) || array_to_string(ls[g * {PAGE_LINES} + 1 : g * {PAGE_LINES} + {PAGE_LINES}], chr(10) || chr(10))), '')"
_SCORE = "CAST(contains(chunk, '##') AS INT) + " + " + ".join(f"CAST(contains(lower(chunk), '{x}') AS INT)" for x in c.PRIORITY)
ORACLES = {
    "custom_chunks": f"WITH RECURSIVE {CUSTOM_SQL} SELECT id, chunk_no, printf('%05d|p%d|%s', chunk_no, page, trim(substr(title, 1, 30), ' ')) AS chunk_id, md5(chunk) AS chunk_md5 FROM cu",
    "dispatched_chunks": f"""WITH RECURSIVE {CUSTOM_SQL}, ma AS (SELECT id, lang, {_PAGES} AS text FROM ls),
        sl AS (SELECT id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 700)) AS a FROM ma WHERE lang = 'de'),
        hl AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM ma WHERE lang = 'fr'), hh AS (SELECT *, ({HEADS}) AS head FROM hl),
        hn AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY id ORDER BY ln) AS INT) AS section FROM hh), hg AS (SELECT id, section, trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY ln), ''), ' ') AS chunk FROM hn GROUP BY id, section),
        pg AS (SELECT id, page, {_STRIP.format("string_agg(line, chr(10) || chr(10) ORDER BY i)")} AS chunk FROM (SELECT li.*, i // {PAGE_LINES} AS page FROM li) GROUP BY id, page),
        pp AS (SELECT pg.id, CAST(row_number() OVER (PARTITION BY pg.id ORDER BY page) AS INTEGER) AS chunk_no, chunk FROM pg JOIN ls ON ls.id = pg.id AND coalesce(lang, '') NOT IN ('en', 'fr', 'de') WHERE length(chunk) >= 120),
        ev AS (SELECT cu.id, 'custom' AS strategy, chunk_no, chunk FROM cu JOIN ls ON ls.id = cu.id AND lang = 'en' UNION ALL SELECT id, 'sliding', CAST(a // 700 + 1 AS INTEGER), substr(text, a + 1, 2400) FROM sl WHERE a // 700 < 40 AND length(substr(text, a + 1, 2400)) >= 1
          UNION ALL SELECT id, 'sections', section + 1, chunk FROM hg WHERE chunk <> '' UNION ALL SELECT id, 'pages', chunk_no, chunk FROM pp),
        rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY {_SCORE} DESC, chunk_no) AS INTEGER) AS rank FROM ev) SELECT id, strategy, rank, chunk_no, md5(chunk) AS chunk_md5 FROM rk WHERE rank <= 28""",
}
