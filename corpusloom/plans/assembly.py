"""Queries over fused answers, source unions, markdown lines and canonical sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import assembly as m
from corpusloom.operators import chunking as c
from corpusloom.plans.analytics import any_sql
from corpusloom.plans.documents import TURNS_SQL, docs, turns
from corpusloom.plans.views import ORACLES as VIEW_ORACLES
from corpusloom.sources.tables import load


def fused_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers of a conversation as one, in the three ways; every third is an analysis."""
    kind = F.when(F.col("turn") % 3 == 0, "synthesis").otherwise("retrieval")
    parts = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("answer"), kind.alias("kind")))).alias("p"), F.min_by("question", "turn").alias("q"))
    return parts.select("conv_id", *[F.md5(m.fused(F.col("p"), k, F.col("q"))).alias(f"{k}_md5") for k in ("concatenate", "synthesis", "weighted")])


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three sources say under one number: documents, pages and benchmark items, 2000 characters each."""
    texts = docs(spark, sf_dir).select(F.col("id").alias("key"), "text", F.lit("").alias("url"))
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("text"), "url")
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("key"), "text", F.lit(None).cast("string").alias("url"))
    return m.source_union([("Wikipedia", texts), ("ArXiv", pages), ("DuckDuckGo", items)], 2000).select("key", F.md5("combined").alias("combined_md5"), "n_sources")


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, some with marks put before them, by kind, and their texts as HTML."""
    lines = docs(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    marked = lines.withColumn("l", F.when(F.col("ln") % 4 == 0, F.concat(F.lit("## "), "line")).when(F.col("ln") % 4 == 1, F.concat(F.lit("- **"), F.split_part("line", F.lit(" "), F.lit(1)), F.lit("** $x = 1$ "), "line")).otherwise(F.col("line")))
    return marked.groupBy("id", m.line_kind(F.col("l")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length(m.line_text(F.col("l")))).alias("size"))


def section_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document by the field that their heading belongs to."""
    sections = c.by_heading(docs(spark, sf_dir).select("id", "text")).withColumn("field", m.canonical_section(F.col("heading")))
    return sections.groupBy(F.coalesce("field", F.lit("none")).alias("field")).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("size"))


def author_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", F.md5(m.author_line(F.split("text", "\n"))).alias("authors_md5"))


QUERIES = {"fused_answers": fused_answers, "source_union": source_union, "markdown_lines": markdown_lines, "section_fields": section_fields, "author_lines": author_lines}

FIELD = "CASE " + " ".join(f"WHEN contains(lower(heading), '{w}') THEN '{f}'" for w, f in m.SECTIONS) + " ELSE 'none' END"
SECTIONS_SQL = VIEW_ORACLES["section_texts"].replace("md5(trim(body, ' ')) AS body_md5", "length(trim(body, ' ')) AS size")
HTML = "regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(trim(l, ' '), '^(## |- |\\* )', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\$([^$\\n]+)\\$', '<code>\\1</code>', 'g'), '\\*\\*(.+?)\\*\\*', '<b>\\1</b>', 'g')"
ORACLES = {
    "fused_answers": f"""WITH {TURNS_SQL}, k AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'synthesis' ELSE 'retrieval' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM turns),
        g AS (SELECT conv_id, min_by(question, turn) AS q, string_agg(CASE WHEN kind = 'synthesis' THEN answer ELSE concat('**Part ', i, ' (', kind, '):**', chr(10), answer) END, chr(10) || chr(10) ORDER BY i) AS a, string_agg(concat('**Context ', i, ':** ', answer), chr(10) || chr(10) ORDER BY i) AS b,
          string_agg(answer, chr(10) || chr(10) ORDER BY i) FILTER (kind <> 'synthesis') AS r, string_agg(answer, chr(10) || chr(10) ORDER BY i) FILTER (kind = 'synthesis') AS s FROM k GROUP BY conv_id)
        SELECT conv_id, md5(a) AS concatenate_md5, md5(concat(chr(10), 'Based on the following context pieces, provide a comprehensive answer to the question: "', q, '"', chr(10), chr(10), b, chr(10), chr(10), '**Synthesized Answer:**', chr(10))) AS synthesis_md5,
          md5(concat_ws(chr(10) || chr(10), '**Retrieved Information:**' || chr(10) || r, '**Analysis:**' || chr(10) || s)) AS weighted_md5 FROM g""",
    "source_union": """WITH u AS (SELECT doc_id AS key, 0 AS p, concat('[Wikipedia]', chr(10), substr(text, 1, 2000)) AS part FROM documents WHERE trim(text, ' ') <> '' UNION ALL SELECT page_id, 1, concat('[ArXiv]', CASE WHEN coalesce(url, '') <> '' THEN ' — ' || url ELSE '' END, chr(10), substr(html, 1, 2000)) FROM pages WHERE trim(html, ' ') <> ''
          UNION ALL SELECT item_id, 2, concat('[DuckDuckGo]', chr(10), substr(text, 1, 2000)) FROM benchmark WHERE trim(text, ' ') <> '')
        SELECT key, md5(string_agg(part, chr(10) || chr(10) ORDER BY p, part)) AS combined_md5, CAST(count(*) AS INTEGER) AS n_sources FROM u GROUP BY key""",
    "markdown_lines": f"""WITH d AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM documents),
        k AS (SELECT id, CASE ln % 4 WHEN 0 THEN '## ' || line WHEN 1 THEN '- **' || string_split(line, ' ')[1] || '** $x = 1$ ' || line ELSE line END AS l FROM d)
        SELECT id, CASE WHEN trim(l, ' ') = '' THEN 'blank' WHEN starts_with(trim(l, ' '), '## ') THEN 'heading' WHEN starts_with(trim(l, ' '), '- ') OR starts_with(trim(l, ' '), '* ') THEN 'bullet' ELSE 'body' END AS kind, count(*) AS n, CAST(sum(length({HTML})) AS BIGINT) AS size FROM k GROUP BY ALL""",
    "section_fields": f"""SELECT {FIELD} AS field, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM ({SECTIONS_SQL}) GROUP BY ALL""",
    "author_lines": f"""WITH l AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:10] AS ls FROM documents)
        SELECT id, md5(coalesce(list_filter(ls, lambda x: contains(x, ',') AND length(x) < 300 AND NOT starts_with(x, '#') AND NOT ({any_sql('lower(x)', m.NO_AUTHORS)}))[1], '')) AS authors_md5 FROM l""",
}
