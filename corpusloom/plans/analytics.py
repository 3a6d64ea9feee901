"""Bibliometric aggregations, facets and paging over the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import mathx, text
from corpusloom.operators import bibliometrics as b
from corpusloom.plans.works import DOCS_SQL, WORKS_SQL, authors, works_docs, works_star

AS_OF = "2002-01-31"
TRANSFORM_QUERY = "transformers"


def any_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def rules_sql(column: str, rules: dict[str, tuple[str, ...]]) -> str:
    return "[" + ", ".join(f"CASE WHEN {any_sql(column, w)} THEN '{k}' END" for k, w in rules.items()) + "]"


def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight authors with most records; names shorter than three characters are ignored."""
    return b.top_counts(authors(spark, sf_dir).filter(F.length(F.trim("author")) >= 3), "author", 8, "n_papers")


def author_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = works_star(spark, sf_dir).select("id", "citations", (F.col("p_size") / 100.0).alias("semantic"))
    return b.author_impact(authors(spark, sf_dir).join(works, "id"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works_star(spark, sf_dir).select("id", F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("tag"))


def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.top_counts(tags(spark, sf_dir).filter(F.trim("tag") != "").select(b.canonical_tag(F.col("tag")).alias("keyword")), "keyword", 10)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.top_counts(works_star(spark, sf_dir).filter("published_date is not null").select(F.substring("published_date", 1, 7).alias("month")), "month", None)


def trend_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.trend(monthly(spark, sf_dir))


def citation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = works_star(spark, sf_dir)
    return works.agg(F.count("*").alias("total"), F.bround(F.avg("citations"), 1).alias("avg_citations"), F.max("citations").alias("max_citations"))


def recent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the last 30 days and later: there is no upper bound."""
    day = F.try_to_date("published_date")
    return works_star(spark, sf_dir).agg(F.count_if(day >= F.date_sub(F.lit(AS_OF).cast("date"), 30)).alias("recent"), F.count("*").alias("total"))


def year_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = works_star(spark, sf_dir).select(text.publication_year("published_date").alias("year")).filter("year is not null")
    return b.top_counts(years, "year", None)


def field_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.top_counts(b.field_rows(works_docs(spark, sf_dir), "body", "tag", TRANSFORM_QUERY).select("label"), "label", 12)


def subtopic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works_docs(spark, sf_dir).select("id", "published_date", F.explode(b.subtopics(F.col("body"), TRANSFORM_QUERY)).alias("label"))


def subtopic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.top_counts(subtopic_labels(spark, sf_dir), "label", 12)


def year_subtopic_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by label and year of the five most frequent labels; the texts are read once, the counts' shuffle serves both sides."""
    counts = subtopic_labels(spark, sf_dir).groupBy("label", F.substring("published_date", 1, 4).alias("year")).agg(F.count("*").alias("n"))
    best = counts.groupBy("label").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "label").limit(5)  # five rows
    return counts.join(F.broadcast(best), "label", "left_semi")


def venue_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    fallback = F.when(F.contains("source", F.lit("arxiv")), "arXiv").otherwise("Unknown Venue")
    return b.top_counts(works_star(spark, sf_dir).select(F.coalesce(text.blank_to_null("venue"), fallback).alias("venue")), "venue", 12)


def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.top_counts(works_star(spark, sf_dir).select(F.explode(F.transform(F.split("source", ","), lambda x: F.trim(x))).alias("source")).filter("source <> ''"), "source", 8)


def top_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = works_star(spark, sf_dir).orderBy(F.desc("citations"), "id").limit(5)
    names = b.ranked_prefix(authors(spark, sf_dir).join(F.broadcast(works.select("id")), "id"), ["id"], [F.col("author")], 2)
    listed = names.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("author")), ", ").alias("authors"))
    return works.join(listed, "id", "left").select("id", "title", "citations", F.substring("published_date", 1, 4).alias("year"), "authors", "source", "venue")


def scored_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a composite of citation, recency and source."""
    works = works_star(spark, sf_dir)
    composite = 0.5 * mathx.citation_blended(F.col("citations"), F.col("published_date"), 2002, 0.35) + 0.3 * mathx.recency(F.col("published_date"), AS_OF) + 0.2 * mathx.source_confidence(F.col("source"))
    return works.withColumn("composite", F.round(composite, 6))


SCORED_SQL = f"""
scored AS (SELECT *, round(0.5 * (CASE WHEN length(published_date) >= 4 THEN
   0.65 * (CASE WHEN citations > 0 THEN least(ln(1 + citations) / ln(1001.0), 1.0) ELSE 0 END)
   + 0.35 * (CASE WHEN citations > 0 THEN least(ln(1 + citations / (greatest(2002 - CAST(substr(published_date, 1, 4) AS INT), 0) + 0.5)) / ln(501.0), 1.0) ELSE 0 END)
   ELSE (CASE WHEN citations > 0 THEN least(ln(1 + citations) / ln(1001.0), 1.0) ELSE 0 END) END)
  + 0.3 * coalesce(exp(-0.000379 * greatest(date_diff('day', CAST(published_date AS DATE), DATE '{AS_OF}'), 0)), 0)
  + 0.2 * (CASE source WHEN 'arxiv' THEN 0.85 ELSE 0.9 END), 6) AS composite FROM works)
"""


def search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets in order: best 500, source, years, least citations; then newest first."""
    best = scored_star(spark, sf_dir).orderBy(F.desc("composite"), "id").limit(500)
    year = text.publication_year("published_date")
    kept = best.filter(F.array_contains(F.transform(F.split("source", ","), lambda x: F.trim(x)), "openalex") & (F.coalesce(year, F.lit(0)) >= 1990) & (F.coalesce(year, F.lit(9999)) <= 2001) & (F.col("citations") >= 3))
    return kept.select("id", "title", "citations", "published_date", "composite")


def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of 25 records, best first."""
    return scored_star(spark, sf_dir).orderBy(F.desc("composite"), "id").offset(50).limit(25).select("id", "title", "composite")


def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 of each primary source; a record of both sources counts for arxiv."""
    primary = F.when(F.contains("source", F.lit("arxiv")), "arxiv").when(F.contains("source", F.lit("openalex")), "openalex")
    return b.ranked_prefix(works_star(spark, sf_dir).withColumn("primary_source", primary), ["primary_source"], [F.col("id")], 50, "place").select("id", "primary_source", "place")


def min_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records above both thresholds; if fewer than 40, the longest of the rest fill up."""
    docs = works_docs(spark, sf_dir).select("id", F.length("abstract").alias("size"), (F.col("id") % 50 / 100.0).alias("semantic"), (F.col("id") % 7 / 10.0).alias("topic"))
    kept = docs.filter("semantic > 0.45 and topic >= 0.55")
    missing = kept.agg(F.greatest(40 - F.count("*"), F.lit(0)).alias("missing"))
    longest = docs.filter("not (semantic > 0.45 and topic >= 0.55)").orderBy(F.desc("size"), "id").limit(40)  # 40 rows are numbered, no more
    rest = longest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "id")))
    fill = rest.join(F.broadcast(missing)).filter("rank <= missing").select("id", "size", F.lit("filled").alias("why"))
    return kept.select("id", "size", F.lit("kept").alias("why")).unionByName(fill)


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records left at each stage, by source and in all."""
    works = scored_star(spark, sf_dir).withColumn("source_name", F.explode(F.split("source", ",")))
    out = works.rollup("source_name").agg(F.count("*").alias("raw"), F.count_if(F.col("citations") >= 10).alias("cited"), F.count_if((F.col("citations") >= 10) & (F.col("composite") >= 0.4)).alias("ranked"))
    return out.select(F.coalesce("source_name", F.lit("all")).alias("source_name"), "raw", "cited", "ranked")


def insight_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = text.publication_year("published_date")
    return works_star(spark, sf_dir).agg(F.count("*").alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.bround(F.avg("citations"), 1).alias("avg_citations"))


QUERIES = {
    "top_authors": top_authors, "author_impact": author_impact, "top_keywords": top_keywords, "monthly_counts": monthly, "trend_status": trend_status,
    "citation_stats": citation_stats, "recent_count": recent_count, "year_distribution": year_distribution, "field_distribution": field_distribution,
    "subtopic_distribution": subtopic_distribution, "year_subtopic_trends": year_subtopic_trends, "venue_distribution": venue_distribution,
    "source_distribution": source_distribution, "top_cited": top_cited, "search_view_facets": search_view, "paginate": paginate,
    "source_cap": source_cap, "min_keep_backfill": min_keep, "funnel_rollup": funnel, "insight_facts": insight_facts,
}

CANONICAL_SQL = """CASE WHEN contains(lower(tag), 'transform') THEN 'Transformers' WHEN contains(lower(tag), 'language') OR lower(tag) = 'nlp' THEN 'NLP'
 WHEN contains(lower(tag), 'vision') OR contains(lower(tag), 'image') THEN 'Computer Vision' WHEN contains(lower(tag), 'multimodal') THEN 'Multimodal AI'
 WHEN contains(lower(tag), 'llm') OR contains(lower(tag), 'foundation') THEN 'LLMs' ELSE tag END"""
LABELS_SQL = f"""found AS (SELECT id, published_date, body, list_filter({rules_sql('body', b.SUBTOPIC_RULES)}, lambda x: x IS NOT NULL) AS ls FROM docs),
labelled AS (SELECT id, published_date, unnest(CASE WHEN len(ls) > 0 THEN ls ELSE ['General Transformers'] END) AS label FROM found)"""

ORACLES = {
    "top_authors": f"WITH {WORKS_SQL} SELECT s_name AS author, count(*) AS n_papers FROM auth WHERE length(trim(s_name)) >= 3 GROUP BY s_name ORDER BY n_papers DESC, author LIMIT 8",
    "author_impact": f"""WITH {WORKS_SQL}, sums AS (SELECT s_name AS author, count(*) AS paper_count, CAST(sum(greatest(citations, 0)) AS BIGINT) AS citations, sum(p_size / 100.0) AS s
        FROM auth JOIN works ON l_partkey = id GROUP BY s_name)
        SELECT author, paper_count, citations, round_even(paper_count * 3.0 + least(citations / 200.0, 50.0) + round(s, 6) * 5.0, 2) AS impact_score FROM sums ORDER BY impact_score DESC, citations DESC, author LIMIT 8""",
    "top_keywords": f"""WITH tags AS (SELECT unnest(string_split(concat(p_name, ' ', lower(p_type)), ' ')) AS tag FROM part)
        SELECT {CANONICAL_SQL} AS keyword, count(*) AS n FROM tags WHERE trim(tag) <> '' GROUP BY 1 ORDER BY n DESC, keyword LIMIT 10""",
    "monthly_counts": f"WITH {WORKS_SQL} SELECT substr(published_date, 1, 7) AS month, count(*) AS n FROM works WHERE published_date IS NOT NULL GROUP BY 1",
    "trend_status": f"""WITH {WORKS_SQL}, m AS (SELECT substr(published_date, 1, 7) AS month, count(*) AS n FROM works WHERE published_date IS NOT NULL GROUP BY 1 ORDER BY month DESC LIMIT 2)
        SELECT CASE WHEN count(*) < 2 THEN 'Stable' WHEN max_by(n, month) > min_by(n, month) THEN 'Rising' WHEN max_by(n, month) < min_by(n, month) THEN 'Declining' ELSE 'Stable' END AS trend,
        max_by(n, month) AS last_count, min_by(n, month) AS previous_count FROM m""",
    "citation_stats": f"WITH {WORKS_SQL} SELECT count(*) AS total, round_even(avg(citations), 1) AS avg_citations, max(citations) AS max_citations FROM works",
    "recent_count": f"WITH {WORKS_SQL} SELECT count(*) FILTER (CAST(published_date AS DATE) >= DATE '{AS_OF}' - 30) AS recent, count(*) AS total FROM works",
    "year_distribution": f"WITH {WORKS_SQL} SELECT CAST(substr(published_date, 1, 4) AS INT) AS year, count(*) AS n FROM works WHERE published_date IS NOT NULL GROUP BY 1",
    "field_distribution": f"""WITH {DOCS_SQL}, found AS (SELECT tag, list_filter({rules_sql('body', b.FIELD_RULES)}, lambda x: x IS NOT NULL) AS ls FROM docs),
        rows AS (SELECT unnest(ls) AS label FROM found UNION ALL SELECT {CANONICAL_SQL} FROM found WHERE trim(tag) <> '' UNION ALL SELECT 'Transformers' FROM found WHERE len(ls) = 0)
        SELECT label, count(*) AS n FROM rows GROUP BY label ORDER BY n DESC, label LIMIT 12""",
    "subtopic_distribution": f"WITH {DOCS_SQL}, {LABELS_SQL} SELECT label, count(*) AS n FROM labelled GROUP BY label ORDER BY n DESC, label LIMIT 12",
    "year_subtopic_trends": f"""WITH {DOCS_SQL}, {LABELS_SQL}, best AS (SELECT label FROM labelled GROUP BY label ORDER BY count(*) DESC, label LIMIT 5)
        SELECT label, substr(published_date, 1, 4) AS year, count(*) AS n FROM labelled WHERE label IN (SELECT label FROM best) GROUP BY ALL""",
    "venue_distribution": f"""WITH {WORKS_SQL} SELECT coalesce(nullif(trim(venue), ''), CASE WHEN contains(source, 'arxiv') THEN 'arXiv' ELSE 'Unknown Venue' END) AS venue, count(*) AS n
        FROM works GROUP BY 1 ORDER BY n DESC, venue LIMIT 12""",
    "source_distribution": f"WITH {WORKS_SQL} SELECT trim(s) AS source, count(*) AS n FROM (SELECT unnest(string_split(source, ',')) AS s FROM works) WHERE trim(s) <> '' GROUP BY 1 ORDER BY n DESC, source LIMIT 8",
    "top_cited": f"""WITH {WORKS_SQL}, best AS (SELECT * FROM works ORDER BY citations DESC, id LIMIT 5),
        names AS (SELECT id, s_name, row_number() OVER (PARTITION BY id ORDER BY s_name) AS k FROM best JOIN auth ON id = l_partkey)
        SELECT id, title, citations, substr(published_date, 1, 4) AS year, (SELECT string_agg(s_name, ', ' ORDER BY s_name) FROM names WHERE names.id = best.id AND k <= 2) AS authors, source, venue FROM best""",
    "search_view_facets": f"""WITH {WORKS_SQL}, {SCORED_SQL}, best AS (SELECT * FROM scored ORDER BY composite DESC, id LIMIT 500)
        SELECT id, title, citations, published_date, composite FROM best WHERE list_contains(string_split(source, ','), 'openalex')
        AND coalesce(CAST(substr(published_date, 1, 4) AS INT), 0) >= 1990 AND coalesce(CAST(substr(published_date, 1, 4) AS INT), 9999) <= 2001 AND citations >= 3""",
    "paginate": f"WITH {WORKS_SQL}, {SCORED_SQL} SELECT id, title, composite FROM scored ORDER BY composite DESC, id LIMIT 25 OFFSET 50",
    "source_cap": f"""WITH {WORKS_SQL}, p AS (SELECT id, CASE WHEN contains(source, 'arxiv') THEN 'arxiv' WHEN contains(source, 'openalex') THEN 'openalex' END AS primary_source FROM works),
        r AS (SELECT *, row_number() OVER (PARTITION BY primary_source ORDER BY id) AS place FROM p) SELECT * FROM r WHERE place <= 50""",
    "min_keep_backfill": f"""WITH d AS (SELECT doc_id AS id, length(text) AS size, doc_id % 50 / 100.0 AS semantic, doc_id % 7 / 10.0 AS topic FROM documents),
        kept AS (SELECT * FROM d WHERE semantic > 0.45 AND topic >= 0.55),
        rest AS (SELECT *, row_number() OVER (ORDER BY size DESC, id) AS k FROM d WHERE NOT (semantic > 0.45 AND topic >= 0.55))
        SELECT id, size, 'kept' AS why FROM kept UNION ALL SELECT id, size, 'filled' FROM rest WHERE k <= greatest(40 - (SELECT count(*) FROM kept), 0)""",
    "funnel_rollup": f"""WITH {WORKS_SQL}, {SCORED_SQL}, e AS (SELECT *, unnest(string_split(source, ',')) AS source_name FROM scored)
        SELECT coalesce(source_name, 'all') AS source_name, count(*) AS raw, count(*) FILTER (citations >= 10) AS cited, count(*) FILTER (citations >= 10 AND composite >= 0.4) AS ranked FROM e GROUP BY ROLLUP (source_name)""",
    "insight_facts": f"""WITH {WORKS_SQL} SELECT count(*) AS n, min(CAST(substr(published_date, 1, 4) AS INT)) AS first_year, max(CAST(substr(published_date, 1, 4) AS INT)) AS last_year, round_even(avg(citations), 1) AS avg_citations FROM works""",
}
