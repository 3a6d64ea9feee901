"""Queries that check and correct responses, and that hold verdicts against their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answers as a
from corpusloom.operators import evidence as e
from corpusloom.operators import reviews as r
from corpusloom.plans.analytics import any_sql
from corpusloom.plans.documents import SENT_SQL, TURNS_SQL, docs, sentences, turns
from corpusloom.plans.works import DOCS_SQL, works_docs

KNOWN = (1, 2, 3, 5, 8)
KINDS = ("equation", "table", "figure", "general")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with element names after it, the kind that its question asks for, and the registry's numbers."""
    told = F.concat(F.col("answer"), F.lit(" See Table "), F.col("turn").cast("string"), F.lit(" and Equation "), (F.col("turn") * 2).cast("string"), F.when(F.col("conv_id") % 3 == 0, F.lit(" and Figure 12.")).otherwise("."))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return turns(spark, sf_dir).select("conv_id", "turn", "question", told.alias("response"), kind.alias("kind"), F.array(*[F.lit(k) for k in KNOWN]).alias("known"))


def checked_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five checks of each response, the relevance gate, what is left of the confidence, and whether a moderate level lets it pass."""
    t = F.col("response")
    rows = responses(spark, sf_dir).withColumn("references", F.size(r.unknown_references(t, F.col("known"))) > 0).withColumn("types", r.mixed_types(t, F.col("kind"))).withColumn("grounding", r.ungrounded(t, F.col("question")))
    rows = rows.withColumn("short", F.length(F.trim(t)) < 50).withColumn("repetition", r.repetitive(t)).withColumn("low", a.relevance(F.col("question"), t) < 0.45)
    factors = {"references": 0.8, "types": 0.7, "grounding": 0.6, "short": 0.9, "repetition": 0.95, "low": 0.4}
    confidence, issues = F.lit(1.0), F.lit(0)
    for name, factor in factors.items():
        confidence = confidence * F.when(F.col(name), factor).otherwise(1.0)
        issues = issues + F.col(name).cast("int")
    rows = rows.withColumn("confidence", F.round(confidence, 6)).withColumn("issues", issues)
    return rows.select("conv_id", "turn", *factors, "confidence", "issues", ((F.col("confidence") >= 0.8) & (F.col("issues") <= 2) & ~F.col("low")).alias("passed"))


def corrected_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with every unknown element's name replaced by the nearest known one, and a note after those with more than one."""
    rows = responses(spark, sf_dir).withColumn("changes", r.unknown_references(F.col("response"), F.col("known")))
    return rows.select("conv_id", "turn", F.size("changes").alias("n_changes"), F.md5(r.corrected(F.col("response"), F.col("changes"), F.size("changes") > 1)).alias("response_md5"))


def consistent_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by the share of specific sentences, with the first sentence as rationale and all as evidence, made consistent; and the evidence without claims."""
    rows = sentences(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"), F.count_if(F.col("sentence").rlike("[0-9]")).alias("n"))
    rows = rows.select("id", F.transform("s", lambda x: x["sentence"]).alias("evidence"), F.when(F.col("n") > 1, "Strong").otherwise("Not enough evidence").alias("verdict"))
    fixed = r.consistent(F.col("verdict"), F.concat(F.lit("This shows that "), F.get("evidence", F.lit(0))), F.col("evidence"), F.lit("High"))
    return rows.select("id", "verdict", F.md5(fixed["rationale"]).alias("rationale_md5"), F.size(fixed["evidence"]).alias("n_evidence"), fixed["confidence"].alias("confidence"), F.size(r.without_claims(F.col("evidence"))).alias("n_unclaimed"))


def identity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works_docs(spark, sf_dir).select("id", F.array_join(r.identity_tokens(F.col("title")), ",").alias("tokens"))


def reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's sentences tell of the signal groups, negations left out."""
    rows = sentences(spark, sf_dir)
    found = e.signal_groups(rows, "id", e.REPRO_SIGNALS).groupBy("id").agg(F.array_sort(F.collect_set("grp")).alias("found"))
    told = rows.groupBy("id").agg(F.collect_list("sentence").alias("evidence"))
    joined = docs(spark, sf_dir).select("id").join(found, "id", "left").join(told, "id", "left")
    none = F.array().cast("array<string>")
    return joined.select("id", r.reproducibility(F.coalesce("found", none), F.coalesce("evidence", none)).alias("rationale"))


QUERIES = {"checked_responses": checked_responses, "corrected_responses": corrected_responses, "consistent_verdicts": consistent_verdicts, "identity_tokens": identity_tokens, "reproducibility": reproducibility}

RESPONSES = f"""{TURNS_SQL}, rs AS (SELECT conv_id, turn, question, concat(answer, ' See Table ', turn, ' and Equation ', turn * 2, CASE WHEN conv_id % 3 = 0 THEN ' and Figure 12.' ELSE '.' END) AS response, [{', '.join("'" + k + "'" for k in KINDS)}][CAST((conv_id + turn) % 4 + 1 AS INT)] AS kind FROM turns),
rf AS (SELECT *, {', '.join(f"list_transform(regexp_extract_all(response, '(?i)(?:^|[^a-z0-9_]){k}\\s+(\\d+)', 1), lambda n: CAST(n AS INT)) AS {k}s" for k in r.TYPES)} FROM rs),
un AS (SELECT *, {', '.join(f"list_filter({k}s, lambda n, i: NOT list_contains([{', '.join(map(str, KNOWN))}], n) AND list_position({k}s, n) = i) AS u{k}" for k in r.TYPES)} FROM rf)"""
NEAR = "CASE " + " ".join(f"WHEN n <= {(x + y) // 2} THEN {x}" for x, y in zip(KNOWN, KNOWN[1:], strict=False)) + f" ELSE {KNOWN[-1]} END"
LISTS = [f"list_transform(u{k}, lambda n: {{'wrong': '{k.capitalize()} ' || n, 'right': '{k.capitalize()} ' || {NEAR}}})" for k in r.TYPES]
CHANGES = f"list_concat(list_concat({LISTS[0]}, {LISTS[1]}), {LISTS[2]})"
BOUND = "(^|[^\\p{L}\\p{N}_])"


def bounded(pattern: str) -> str:
    """A pattern whose word edges are told without the engine's own."""
    body = pattern.removeprefix("(?i)").removeprefix("\\b").removesuffix("\\b")
    after = "($|[^\\p{L}\\p{N}_])"
    if "(%|" in body:  # the edge after a percent sign is a word character
        head, _, tail = body.partition("(%|")
        return f"(?i){BOUND}{head}(%[\\p{{L}}\\p{{N}}_]|({tail}{after})"
    return f"(?i){BOUND}{body}{after}"


ORACLES = {
    "corrected_responses": f"""WITH RECURSIVE {RESPONSES}, c AS (SELECT conv_id, turn, response, {CHANGES} AS cs FROM un), f AS (SELECT conv_id, turn, response, cs, 0 AS i FROM c UNION ALL SELECT conv_id, turn, replace(response, cs[i + 1].wrong, cs[i + 1].right), cs, i + 1 FROM f WHERE i < len(cs))
        SELECT conv_id, turn, CAST(len(cs) AS INTEGER) AS n_changes, md5(CASE WHEN len(cs) > 1 THEN response || chr(10) || chr(10) || '{r.WARNING.strip()}' ELSE response END) AS response_md5 FROM f WHERE i = len(cs)""",
    "consistent_verdicts": f"""WITH {SENT_SQL}, g AS (SELECT id, list(sentence ORDER BY pos) AS ev, count(*) FILTER (regexp_matches(sentence, '[0-9]')) AS n FROM sents GROUP BY id), v AS (SELECT *, n <= 1 AS nee, 'This shows that ' || ev[1] AS ra, list_filter(ev, lambda x: NOT regexp_matches(x, '{bounded(r.CLAIMED)}')) AS kept FROM g)
        SELECT id, CASE WHEN nee THEN 'Not enough evidence' ELSE 'Strong' END AS verdict, md5(CASE WHEN nee THEN '{r.NEUTRAL}' ELSE ra END) AS rationale_md5, CAST(CASE WHEN nee THEN len(list_filter(ev, lambda x: NOT regexp_matches(x, '{bounded(r.METRIC)}'))) ELSE len(ev) END AS INTEGER) AS n_evidence,
          CASE WHEN nee OR regexp_matches(ra, '{bounded(r.ABSENT)}') THEN 'Low' ELSE 'High' END AS confidence, CAST(CASE WHEN len(kept) > 0 THEN len(kept) ELSE len(ev) END AS INTEGER) AS n_unclaimed FROM v""",
    "reproducibility": f"""WITH {SENT_SQL}, ok AS (SELECT id, lower(sentence) AS low FROM sents), fo AS (""" + " UNION ".join(f"SELECT id, '{k}' AS grp FROM ok WHERE NOT regexp_matches(low, '{e.NEGATION}') AND {any_sql('low', w)}" for k, w in e.REPRO_SIGNALS.items()) + f"""),
        ti AS (SELECT id, bool_or({any_sql('low', r.RELEASED)} AND NOT {any_sql('low', r.DENIED)}) AS told FROM ok GROUP BY id), fl AS (SELECT id, list_sort(list(grp)) AS f FROM fo GROUP BY id),
        j AS (SELECT doc_id AS id, coalesce(f, []) AS f, coalesce(told, false) AS told, list_filter([{', '.join("'" + k + "'" for k in sorted(e.REPRO_SIGNALS))}], lambda k: NOT list_contains(coalesce(f, []), k)) AS absent FROM documents LEFT JOIN fl ON doc_id = fl.id LEFT JOIN ti ON doc_id = ti.id),
        p AS (SELECT id, list_filter([CASE WHEN len(f) > 0 THEN 'Reproducibility signals present: ' || array_to_string(f, ', ') || '.' END, CASE WHEN len(absent) > 0 THEN 'Missing signals: ' || array_to_string(absent, ', ') || '.' END, CASE WHEN NOT told THEN 'No code or checkpoint release is mentioned in the extracted text.' END], lambda x: x IS NOT NULL) AS ps FROM j)
        SELECT id, CASE WHEN len(ps) > 0 THEN array_to_string(ps, ' ') ELSE 'Partial reproducibility evidence found in the extracted text.' END AS rationale FROM p""",
}
# words of a title that hold other than ASCII letters are no tokens
ORACLES["identity_tokens"] = f"""WITH {DOCS_SQL}, w AS (SELECT id, list_filter(string_split(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_-]+', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]') AND length(x) >= 3) AS ws FROM docs),
    s AS (SELECT id, list_transform(list_filter(ws, lambda x: upper(x) = x), lambda x: lower(x)) AS ac, list_sort(list_distinct(list_filter(list_transform(ws, lambda x: lower(x)), lambda x: length(x) >= 5 AND x NOT IN ({', '.join("'" + t + "'" for t in r.TITLE_STOP)}))))[1:6] AS lo FROM w)
    SELECT id, array_to_string(list_sort(list_distinct(list_concat(ac, lo))), ',') AS tokens FROM s"""
_WS = "list_distinct(regexp_extract_all(lower(question), '[a-z]{3,}'))"
_SENTS = "list_filter(list_transform(regexp_split_to_array(response, '[.!?]+'), lambda s: lower(trim(s, ' '))), lambda s: length(s) > 10)"
_NUMBERS = "list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+(?:\\.\\d+)?'), lambda n: regexp_full_match(n, '\\d+(\\.\\d+)?'))"
ORACLES["checked_responses"] = f"""WITH {RESPONSES}, k AS (SELECT conv_id, turn, len(uequation) + len(utable) + len(ufigure) > 0 AS "references",
      (kind = 'equation' AND (len(tables) > 0 OR len(figures) > 0)) OR (kind = 'table' AND (len(equations) > 0 OR len(figures) > 0)) OR (kind = 'figure' AND (len(equations) > 0 OR len(tables) > 0)) AS types,
      ({' + '.join(f"CAST(contains(lower(response), '{h}') AS INT)" for h in r.HEDGES)}) > 2 OR len(list_filter(({_NUMBERS.format('response')})[1:10], lambda n: length(n) > 2 AND NOT list_contains({_NUMBERS.format('question')}, n))) > 3 AS grounding,
      length(trim(response, ' ')) < 50 AS short, len({_SENTS}) > 5 AND len(list_distinct({_SENTS})) < len({_SENTS}) * 0.7 AS repetition,
      CASE WHEN len({_WS}) > 0 THEN len(list_filter({_WS}, lambda x: contains(lower(response), x))) / len({_WS}) ELSE 0.0 END < 0.45 AS low FROM un),
    v AS (SELECT *, round({' * '.join(f'(CASE WHEN "{n}" THEN {f} ELSE 1.0 END)' for n, f in (("references", 0.8), ("types", 0.7), ("grounding", 0.6), ("short", 0.9), ("repetition", 0.95), ("low", 0.4)))}, 6) AS confidence, {' + '.join(f'CAST("{n}" AS INT)' for n in ("references", "types", "grounding", "short", "repetition", "low"))} AS issues FROM k)
    SELECT conv_id, turn, "references", types, grounding, short, repetition, low, CAST(confidence AS DOUBLE) AS confidence, issues, confidence >= 0.8 AND issues <= 2 AND NOT low AS passed FROM v"""
