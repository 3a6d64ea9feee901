"""Validation, decomposition, context and verdict queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answers as a
from corpusloom.operators import evidence as e
from corpusloom.operators import querying as q
from corpusloom.operators.expansion import TERM_STOP, query_terms
from corpusloom.operators.retrieval import held_terms
from corpusloom.plans.documents import CLAIM_SQL, TURNS_SQL, claims, turns
from corpusloom.plans.records import QUERY_SQL, query_texts
from corpusloom.plans.works import DOCS_SQL, works_docs
from corpusloom.sources.tables import load


def validate_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers judged against their questions: grounding, length, repetition and relevance."""
    rows = turns(spark, sf_dir)
    lost = F.size(F.array_except(F.filter(e.numbers(F.col("answer")), lambda n: F.length(n) > 2), e.numbers(F.col("question"))))
    marked = rows.select("conv_id", "turn", F.round(a.relevance(F.col("question"), F.col("answer")), 6).alias("relevance"), (lost > 3).alias("grounding"), (F.length(F.trim("answer")) < 50).alias("completeness"))
    checks = {"grounding": F.col("grounding"), "completeness": F.col("completeness"), "relevance": F.col("relevance") < 0.45}
    value, issues = a.confidence(checks)
    return marked.select("conv_id", "turn", "relevance", F.round(value, 6).alias("confidence"), issues.alias("issues"), *[a.passed(F.round(value, 6), issues, level, checks["relevance"]).alias(level) for level in a.LEVELS])


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-questions of every question and the batch that each can run in."""
    steps = a.decomposed(query_texts(spark, sf_dir), "query_id", "query")
    return steps.join(a.execution_batches(steps, "query_id"), ["query_id", "step"])


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with element bonuses: a matching type, any of the first terms, the element's number in the query."""
    from corpusloom.plans import search

    # of the four kinds by id, the third is a table and the first a text
    bonus = lambda q, i: (i % 4 == 2) * 0.15 + 0.05 + (i % 10 == q % 10) * 0.25 + (i % 4 != 0) * 0.02
    return search.r.bm25_topk(search.texts(spark, sf_dir), search.text.tokens_long("text"), search.query_terms(spark, sf_dir), 5, bonus)


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    return a.context_text(rows, "conv_id", [F.col("turn")], F.col("answer"), 120).select("conv_id", F.md5("context").alias("context_md5"))


def key_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source as pages of a book."""
    pages = works_docs(spark, sf_dir).select("source", F.col("id").alias("page"), F.round(a.page_score(F.col("abstract"), F.contains("abstract", F.lit("igure")), F.lit(0), F.col("id") % 5), 6).alias("score"))
    return a.key_pages(pages, "source", "page", "score")


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of a document's lines, folded as pages are."""
    rows = works_docs(spark, sf_dir).select("id", F.filter(F.transform(F.split("abstract", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("pages"))
    return rows.select("id", F.size(a.merged_pages(F.col("pages"))).alias("n_chunks"))


def source_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works_docs(spark, sf_dir).select("id", "source", (F.col("id") % 97).alias("score"))
    return a.source_spread(rows.filter("source = 'src0'"), rows, 3)


VOCABULARY = ("Multiple concrete strengths supported by evidence", "Some strengths are supported, others are partial", "Limited concrete strengths identifiable from the text")
RAW = ("some strengths are supported, others are partial", "many concrete strengths with evidence", "limited strengths in text", "strengths", "nothing here")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW]), (F.col("p_partkey") % 5 + 1).cast("int"))
    stated = F.element_at(F.array(F.lit("High"), F.lit("medium"), F.lit("low")), (F.col("p_size") % 3 + 1).cast("int"))
    found = claims(spark, sf_dir).groupBy("id").agg(F.count_if(F.col("sentence").rlike(e.SPECIFIC)).alias("n"))
    rows = part.select(F.col("p_partkey").alias("id"), raw.alias("raw"), stated.alias("stated")).join(found, "id")
    return rows.select("id", a.enforced(F.col("raw"), VOCABULARY, "Not enough evidence").alias("verdict"), a.capped_confidence(F.col("stated"), F.lit(False), F.col("n")).alias("confidence"))


def page_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the terms of a question that they hold, two more for the first two side by side; three best for every question."""
    asked = query_texts(spark, sf_dir).select("query_id", query_terms(F.col("query")).alias("words"))
    return held_terms(works_docs(spark, sf_dir).select("id", "body"), asked, 3)


QUERIES = {"validate_response": validate_response, "decomposition": decomposition, "lexical_search": lexical_search, "context_blocks": context_blocks, "key_pages": key_pages, "merged_pages": merged_pages,
           "source_spread": source_spread, "verdicts": verdicts, "page_fallback": page_fallback}


def steps_sql(made: tuple, pattern: str) -> str:
    """A list of steps with the pattern's groups in place of the names in braces."""
    parts = {"q": "query", "a": f"trim(regexp_extract(low, '{pattern}', 1), ' ')", "b": f"trim(regexp_extract(low, '{pattern}', 2), ' ')"}
    text = lambda t: " || ".join(parts[x[1]] if re.fullmatch(r"\{\w\}", x) else f"'{x}'" for x in re.split(r"(\{\w\})", t) if x)
    return "[" + ", ".join(f"{{'sub_query': {text(t)}, 'kind': '{k}', 'priority': {p}, 'depends': '{d}'}}" for t, k, p, d in made) + "]"


def _oracles() -> dict[str, str]:
    from corpusloom.plans.search import ONE

    page = "(CASE WHEN contains(abstract, 'igure') THEN 4.0 ELSE 0.0 END + 2.0 * least(id % 5, 3) + 20.0 * (length(abstract) - length(regexp_replace(abstract, '[=+*/^<>∑∫√≤≥±×α-ω]', '', 'g'))) / length(abstract))"
    level = lambda n: f"(conf >= {a.LEVELS[n][0]} AND issues <= {a.LEVELS[n][1]} AND relevance >= 0.45) AS {n}"
    shared = lambda v: "len(list_intersect(ws, [" + ", ".join("'" + w + "'" for w in sorted({w.strip(',') for w in v.lower().split() if len(w.strip(',')) >= 3})) + "]))"
    return {
        "validate_response": f"""WITH {TURNS_SQL}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '[a-z]{{3,}}')) AS ws, lower(answer) AS low, list_distinct(list_filter(regexp_extract_all(answer, '[0-9]+(?:\\.[0-9]+)?'), lambda x: length(x) > 2)) AS na,
              regexp_extract_all(question, '[0-9]+(?:\\.[0-9]+)?') AS nq FROM turns),
            r AS (SELECT conv_id, turn, round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: contains(low, x))) / len(ws) ELSE 0.0 END, 6) AS relevance, len(list_filter(na, lambda x: NOT list_contains(nq, x))) > 3 AS g, length(trim(answer, ' ')) < 50 AS c FROM w),
            s AS (SELECT *, round((CASE WHEN g THEN 0.6 ELSE 1.0 END) * (CASE WHEN c THEN 0.9 ELSE 1.0 END) * (CASE WHEN relevance < 0.45 THEN 0.4 ELSE 1.0 END), 6) AS conf, CAST(g AS INT) + CAST(c AS INT) + CAST(relevance < 0.45 AS INT) AS issues FROM r)
            SELECT conv_id, turn, relevance, conf AS confidence, issues, {level('strict')}, {level('moderate')}, {level('lenient')} FROM s""",
        "decomposition": f"""WITH {QUERY_SQL}, l AS (SELECT query_id, query, trim(lower(query), ' ') AS low FROM qs), m AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(low, '{p}') THEN {i}" for i, (p, _, _) in enumerate(a.PARTED))} END AS rule FROM l),
            s AS (SELECT query_id, CASE {' '.join(f"WHEN rule = {i} THEN '{t}'" for i, (_, t, _) in enumerate(a.PARTED))} ELSE 'simple' END AS type, CASE {' '.join(f"WHEN rule = {i} THEN {steps_sql(made, p)}" for i, (p, _, made) in enumerate(a.PARTED))} ELSE {steps_sql(a.SIMPLE_STEPS, '')} END AS ss FROM m),
            e AS (SELECT query_id, type, unnest(ss) AS s, CAST(unnest(range(0, len(ss))) AS INTEGER) AS step FROM s)
            SELECT query_id, type, step, s.sub_query, s.kind, s.priority, s.depends, CASE WHEN s.depends = '' THEN 0 ELSE 1 END AS batch FROM e""",
        "lexical_search": f"""{ONE}, s AS (SELECT query_id, id, round(score + CASE WHEN id % 4 = 2 THEN 0.15 ELSE 0 END + 0.05 + CASE WHEN id % 10 = query_id % 10 THEN 0.25 ELSE 0 END + CASE WHEN id % 4 <> 0 THEN 0.02 ELSE 0 END, 6) AS score FROM bm)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
        "context_blocks": f"""WITH {TURNS_SQL}, n AS (SELECT conv_id, answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM turns)
            SELECT conv_id, md5(string_agg('[V' || k || '] ' || rtrim(substr(answer, 1, 120), ' ') || CASE WHEN length(answer) > 120 THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY k)) AS context_md5 FROM n GROUP BY conv_id""",
        "key_pages": f"""WITH {DOCS_SQL}, p AS (SELECT source, id AS page, round({page}, 6) AS score FROM docs), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, page) AS k, min(page) OVER (PARTITION BY source) AS lo, max(page) OVER (PARTITION BY source) AS hi FROM p)
            SELECT source, page, score FROM r WHERE page = lo OR page = hi OR (k <= 8 AND score > 0.5)""",
        "source_spread": """WITH d AS (SELECT doc_id AS id, source, doc_id % 97 AS score FROM documents), m AS (SELECT first(id ORDER BY score DESC, id) AS id, source, max(score) AS score FROM d WHERE source <> 'src0' GROUP BY source ORDER BY score DESC, id LIMIT 2)
            SELECT id, source, score FROM d WHERE source = 'src0' UNION ALL SELECT id, source, score FROM m""",
        "verdicts": f"""WITH {CLAIM_SQL}, n AS (SELECT id, count(*) FILTER (regexp_matches(sentence, '{e.SPECIFIC}')) AS n FROM cl GROUP BY id),
            r AS (SELECT p_partkey AS id, [{', '.join("'" + x + "'" for x in RAW)}][CAST(p_partkey % 5 + 1 AS INT)] AS raw, p_size % 3 AS s, n FROM part JOIN n ON p_partkey = n.id), w AS (SELECT *, regexp_extract_all(raw, '[a-z]{{3,}}') AS ws FROM r),
            x AS (SELECT *, {shared(VOCABULARY[0])} AS a, {shared(VOCABULARY[1])} AS b, {shared(VOCABULARY[2])} AS c FROM w), l AS (SELECT *, CASE WHEN s = 0 THEN CASE WHEN n < 3 THEN 2 ELSE 3 END WHEN s = 1 THEN 2 ELSE 1 END AS v FROM x)
            SELECT id, CASE WHEN raw = lower('{VOCABULARY[1]}') THEN '{VOCABULARY[1]}' WHEN greatest(a, b, c) < 2 THEN 'Not enough evidence' WHEN a = greatest(a, b, c) THEN '{VOCABULARY[0]}' WHEN b = greatest(a, b, c) THEN '{VOCABULARY[1]}' ELSE '{VOCABULARY[2]}' END AS verdict,
            CASE WHEN v = 3 THEN 'High' WHEN v = 2 AND n >= 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM l""",
        "merged_pages": f"""WITH RECURSIVE {DOCS_SQL}, p AS (SELECT id, list_filter(list_transform(string_split(abstract, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM docs),
            f AS (SELECT id, ps, 0 AS i, 0 AS n, '' AS buf FROM p UNION ALL SELECT id, ps, i + 1, CASE WHEN buf <> '' AND length(buf) + length(ps[i + 1]) >= 4000 AND length(trim(buf, ' ')) >= 150 THEN n + 1 ELSE n END,
              CASE WHEN buf <> '' AND length(buf) + length(ps[i + 1]) < 4000 THEN buf || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END FROM f WHERE i < len(ps))
            SELECT id, CAST(CASE WHEN length(trim(buf, ' ')) >= 150 THEN n + 1 ELSE n END AS INTEGER) AS n_chunks FROM f WHERE i = len(ps)""",
        "page_fallback": f"""WITH {DOCS_SQL}, {QUERY_SQL}, k AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9\\-]{{1,}}'), lambda t: t NOT IN ({', '.join("'" + w + "'" for w in TERM_STOP)})) AS raw FROM qs),
            u AS (SELECT query_id, list_filter(raw, lambda w, i: list_position(raw, w) = i)[1:10] AS ws FROM k),
            h AS (SELECT query_id, id, len(list_filter(ws, lambda w: contains(body, w))) AS n, len(ws) > 1 AND contains(body, array_to_string(ws[1:2], ' ')) AS p FROM docs, u), s AS (SELECT query_id, id, n + CASE WHEN p THEN 2 ELSE 0 END AS score FROM h WHERE n > 0)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""",
    }


ORACLES = _oracles()
