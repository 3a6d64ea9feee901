"""Relevance queries over documents: one expansion of a query, held in literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import relevance as rel
from corpusloom.plans.analytics import any_sql
from corpusloom.plans.records import SPACED
from corpusloom.plans.works import DOCS_SQL, works_docs

QUERIES_ASKED = ["the and of to", "der die und", "que de la"]
KEYWORDS = ["the and", "token", "eaux", "une"]
PROFILE = {"aliases": ["the an", "und"], "acronym": "des", "subtopics": ["las"], "methods": ["for the"], "exclusions": ["license"]}


def lexical_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = works_docs(spark, sf_dir)
    return docs.select("id", rel.lexical(F.col("title"), F.lower(F.concat_ws(" ", "abstract", "tag")), QUERIES_ASKED, KEYWORDS).alias("lexical"))


def topic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = works_docs(spark, sf_dir)
    scored = docs.select("id", "title", "source", rel.topic(F.lower("title"), F.lower("abstract"), F.lower("tag"), F.lower("source"), PROFILE, QUERIES_ASKED, KEYWORDS).alias("topic"),
                         rel.lexical(F.col("title"), F.lower(F.concat_ws(" ", "abstract", "tag")), QUERIES_ASKED, KEYWORDS).alias("lexical"))
    return scored.select("id", "topic", F.round(rel.blended(F.col("topic"), F.col("lexical"), F.array("source")), 4).alias("blended"), F.round(rel.title_gate(F.col("topic")), 6).alias("gate"),
                         rel.concept_boost(F.col("title"), "eaux").alias("concept"))


QUERIES = {"lexical_relevance": lexical_relevance, "topic_relevance": topic_relevance}

NORM = SPACED.format(c="title")


def strength_sql(phrase: str) -> str:
    p = rel._norm(phrase)
    n = len(p.split())
    if n < 4:
        return "0.0"
    return (f"CASE WHEN nt = '' THEN 0.0 WHEN nt = '{p}' THEN 1.0 WHEN starts_with(nt, '{p} ') THEN CASE WHEN len(string_split(nt, ' ')) - {n} <= 2 THEN 1.0 WHEN len(string_split(nt, ' ')) - {n} <= 5 THEN 0.48 ELSE 0.22 END "
            f"WHEN contains(nt, '{p}') THEN 0.35 ELSE 0.0 END")


def step_sql(s: str, high: float, middle: float, low: float) -> str:
    return f"CASE WHEN {s} >= 0.95 THEN {high} WHEN {s} >= 0.4 THEN {middle} WHEN {s} > 0 THEN {low} ELSE 0.0 END"


def total_sql(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w.lower()}') AS INT)" for w in words) + ")"


WORDS = rel.tokens_of(KEYWORDS)
LEX = f"""{DOCS_SQL}, d0 AS (SELECT id, title, lower(title) AS low, {NORM} AS nt, lower(abstract || ' ' || tag) AS body, lower(abstract) AS la, lower(tag) AS lt, lower(source) AS lv, source FROM docs),
d1 AS (SELECT *, {total_sql('body', KEYWORDS)} AS hits, {strength_sql(QUERIES_ASKED[0])} AS s0 FROM d0),
d2 AS (SELECT *, CASE WHEN hits >= 2 THEN 1.0 ELSE 0.5 END AS h, ({step_sql('s0', 0.70, 0.48, 0.30)}) * (CASE WHEN hits >= 2 THEN 1.0 ELSE 0.5 END) AS t0 FROM d1),
d3 AS (SELECT *, CASE WHEN t0 < 0.60 THEN ({step_sql('s0', 0.60, 0.42, 0.28)}) * h ELSE 0.0 END AS t1 FROM d2),
lx AS (SELECT *, round_even(greatest(t0 + t1 + CASE WHEN t0 + t1 < 0.50 AND {any_sql('body', tuple(q.lower() for q in QUERIES_ASKED))} THEN 0.40 ELSE 0.0 END
  + {total_sql('low', WORDS)} / {len(WORDS)} * 0.35 + {total_sql('body', WORDS)} / {len(WORDS)} * 0.30 + CASE WHEN contains(low, 'the and') THEN 0.10 ELSE 0.0 END - CASE WHEN (t0 > 0 OR t1 > 0) AND hits = 0 THEN 0.15 ELSE 0.0 END, 0.0), 4) AS lexical FROM d3)"""
WHOLE = "(low || ' ' || la || ' ' || lt || ' ' || lv)"
SINGLE = ["token", "eaux", "une", "las"]
TOPIC = f"""tp AS (SELECT *, {strength_sql(QUERIES_ASKED[0])} AS st FROM lx),
ts AS (SELECT *, greatest(CASE WHEN {any_sql('low', ('the an', 'und'))} THEN 1.0 ELSE 0.0 END, {step_sql('st', 0.95, 0.62, 0.48)}, CASE WHEN {' OR '.join(f"(contains(low, '{w}') AND NOT contains(lt, '{w}'))" for w in SINGLE)} THEN 0.55 ELSE 0.0 END) AS a,
  CASE WHEN {any_sql('la', ('the an', 'und'))} OR {any_sql(WHOLE, ('the and', 'for the'))} THEN 1.0 ELSE 0.0 END AS b, CASE WHEN {any_sql('lt', ('the an', 'und', *SINGLE))} THEN 1.0 ELSE 0.0 END AS c,
  greatest({step_sql('st', 1.0, 0.52, 0.28)}, CASE WHEN {' OR '.join(f"(contains(la, '{q}')" + (' AND st < 0.42' if len(q.split()) >= 4 else '') + ')' for q in QUERIES_ASKED)} THEN 0.38 ELSE 0.0 END) AS l,
  CASE WHEN regexp_matches(regexp_replace({WHOLE}, '[^\\x00-\\x7F]', '_', 'g'), '\\bdes\\b') THEN 1.0 ELSE 0.0 END AS y FROM tp),
tq AS (SELECT *, round_even(greatest(0.30 * a + 0.30 * b + 0.20 * c + 0.10 * l + 0.05 * y - CASE WHEN contains(low, 'license') THEN 0.15 WHEN contains(la, 'license') THEN 0.10 ELSE 0.0 END
  - CASE WHEN a + b + c + l + y < 0.5 AND {any_sql(WHOLE, rel.GENERIC)} THEN 0.22 ELSE 0.0 END, 0.0), 4) AS topic FROM ts)"""
ORACLES = {
    "lexical_relevance": f"WITH {LEX} SELECT id, lexical FROM lx",
    "topic_relevance": f"""WITH {LEX}, {TOPIC} SELECT id, topic, round(round_even(least(1.0, 0.72 * topic + 0.28 * lexical), 4), 4) AS blended, round(CASE WHEN topic >= 0.5 THEN 1.0 WHEN topic >= 0.3 THEN 0.5 + (topic - 0.3) / 0.2 * 0.5 ELSE 0.3 END, 6) AS gate,
        CASE WHEN contains(string_split(lower(title), ' ')[1], 'eaux') THEN 0.25 ELSE 0.0 END - CASE WHEN {any_sql('lower(title)', ('using eaux', 'with eaux', 'based on eaux', 'for eaux'))} THEN 0.15 ELSE 0.0 END AS concept FROM tq""",
}
