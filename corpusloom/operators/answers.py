"""Validation scores, sub-query plans, context assembly and rule verdicts for generated answers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.bibliometrics import has_any

# What each failed check leaves of the confidence, and the decision levels (confidence, issues).
MULTIPLIERS = {"references": 0.8, "types": 0.7, "grounding": 0.6, "completeness": 0.9, "repetition": 0.95, "relevance": 0.4}
LEVELS = {"strict": (0.95, 0), "moderate": (0.80, 2), "lenient": (0.60, 5)}
# Patterns of questions with parts, in order; the first match wins. {a} and {b} are the pattern's groups, {q} the question.
COMPARATIVE = (
    (r"compare\s+(.+?)\s+(?:and|with|to)\s+(.+?)(?:\s|$)", "comparison"),
    (r"difference\s+(?:between\s+)?(.+?)\s+and\s+(.+?)(?:\s|$)", "difference"),
    (r"relation(?:ship)?\s+between\s+(.+?)\s+and\s+(.+?)(?:\s|$)", "relation"),
    (r"(.+?)\s+versus\s+(.+?)(?:\s|$)", "versus"),
    (r"(.+?)\s+vs\.?\s+(.+?)(?:\s|$)", "versus"),
    (r"how\s+(?:does|do)\s+(.+?)\s+(?:differ|compare)\s+(?:from|to|with)\s+(.+?)(?:\s|$)", "comparison"),
)
SEQUENTIAL = (
    (r"(.+?),\s*then\s+(.+)", "sequential"), (r"first\s+(.+?),\s*(?:then|and then|next)\s+(.+)", "sequential"),
    (r"(.+?)\s+and\s+also\s+(.+)", "additive"), (r"(.+?)\s+as\s+well\s+as\s+(.+)", "additive"),
)
COMPARE_STEPS = (("What is {a}?", "retrieval", 1, ""), ("What is {b}?", "retrieval", 1, ""), ("Compare {a} and {b}", "synthesis", 2, "0,1"))
SEQUENCE_STEPS = (("{a}", "retrieval", 1, ""), ("{b}", "retrieval", 2, "0"))
REFERENCE = (
    (r"(?:table|tbl)\s+(\d+)\s+and\s+(?:equation|eq)\s+(\d+)", "table_equation",
     (("Show table {a}", "table_retrieval", 1, ""), ("Show equation {b}", "equation_retrieval", 1, ""), ("Relate the results from table {a} to equation {b}", "synthesis", 2, "0,1"))),
    (r"(?:figure|fig)\s+(\d+)\s+and\s+(?:table|tbl)\s+(\d+)", "figure_table",
     (("Show figure {a}", "figure_retrieval", 1, ""), ("Show table {b}", "table_retrieval", 1, ""), ("How do figure {a} and table {b} relate?", "synthesis", 2, "0,1"))),
    (r"(?:equation|eq)\s+(\d+)\s+and\s+(?:equation|eq)\s+(\d+)", "equation_equation",
     (("Show equation {a}", "equation_retrieval", 1, ""), ("Show equation {b}", "equation_retrieval", 1, ""), ("What is the relationship between equation {a} and equation {b}?", "synthesis", 2, "0,1"))),
    (r"results?\s+(?:of|from)\s+(?:table|tbl)\s+(\d+)", "table_results", (("Show table {a} with all details", "table_retrieval", 1, ""),)),
    (r"(?:using|based on)\s+(?:equation|eq)\s+(\d+)", "equation_based", (("Show equation {a}", "equation_retrieval", 1, ""), ("{q}", "synthesis", 2, "0"))),
)
SIMPLE_STEPS = (("{q}", "simple", 1, ""),)
#: (pattern, type, steps) of all of them.
PARTED = tuple((p, t, COMPARE_STEPS) for p, t in COMPARATIVE) + REFERENCE + tuple((p, t, SEQUENCE_STEPS) for p, t in SEQUENTIAL)


def relevance(query: Column, context: Column) -> Column:
    """Share of the query's words of three letters or more that the context holds."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z]{3,}"), F.lit(0)))
    low = F.lower(context)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words)).otherwise(0.0)


def confidence(checks: dict[str, Column]) -> tuple[Column, Column]:
    """(confidence, number of issues) from flags that are true where a check fails."""
    left = reduce(lambda a, n: a * F.when(checks[n], MULTIPLIERS[n]).otherwise(1.0), checks, F.lit(1.0))
    return left, reduce(lambda a, n: a + checks[n].cast("int"), checks, F.lit(0))


def passed(value: Column, issues: Column, level: str, irrelevant: Column) -> Column:
    least, most = LEVELS[level]
    return (value >= least) & (issues <= most) & ~irrelevant


def repeated(c: Column) -> Column:
    """A sentence of twenty characters or more stands twice."""
    long = F.filter(text.sentences(c), lambda s: F.length(s) >= 20)
    return F.size(long) > F.size(F.array_distinct(long))


def filled(template: str, parts: dict[str, Column]) -> Column:
    """A template with columns for its names in braces."""
    pieces = [x for x in re.split(r"(\{\w\})", template) if x]
    return F.concat(*[parts[x[1]] if re.fullmatch(r"\{\w\}", x) else F.lit(x) for x in pieces])


def decomposed(rows: DataFrame, key: str, query: str) -> DataFrame:
    """(key, type, step, sub_query, kind, priority, depends): a question's sub-questions, by the first pattern that it holds; a simple one is itself."""
    low = F.lower(F.trim(query))
    chosen = F.lit(None).cast("int")
    for i, (pattern, _, _) in reversed(list(enumerate(PARTED))):
        chosen = F.when(low.rlike(pattern), i).otherwise(chosen)
    marked = rows.select(key, F.col(query).alias("__q"), low.alias("__low"), chosen.alias("__rule"))
    steps = lambda made, parts: F.array(*[F.struct(filled(t, parts).alias("sub_query"), F.lit(k).alias("kind"), F.lit(p).alias("priority"), F.lit(d).alias("depends")) for t, k, p, d in made])
    out, kind = steps(SIMPLE_STEPS, {"q": F.col("__q")}), F.lit("simple")
    for i, (pattern, name, made) in enumerate(PARTED):
        group = lambda g, pattern=pattern: F.trim(F.regexp_extract("__low", pattern, g))
        parts = {"q": F.col("__q"), "a": group(1), **({"b": group(2)} if "{b}" in str(made) else {})}
        out, kind = F.when(F.col("__rule") == i, steps(made, parts)).otherwise(out), F.when(F.col("__rule") == i, name).otherwise(kind)
    return marked.select(key, kind.alias("type"), F.posexplode(out).alias("step", "s")).select(key, "type", "step", "s.sub_query", "s.kind", "s.priority", "s.depends")


#: Types of questions whose answers are fused.
FUSED = ("comparison", "difference", "relation", "synthesis")


def uses_fusion(kind: Column) -> Column:
    return F.coalesce(kind.isin(*FUSED), F.lit(False))


def execution_batches(steps: DataFrame, key: str) -> DataFrame:
    """(key, step, batch): by priority and then step, a step runs if all it depends on has run before; the batches are the priorities that something runs in, from 0.

    A step that depends on a missing one, itself or a later one has no batch.
    """
    deps = F.transform(F.filter(F.split("depends", ","), lambda d: d != ""), lambda d: d.cast("int"))
    lists = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("priority", "step", deps.alias("deps")))).alias("steps"))
    none = F.array().cast("array<struct<priority:int,step:int>>")
    ran = F.aggregate("steps", none, lambda done, s: F.when(F.forall(s["deps"], lambda d: F.exists(done, lambda x: x["step"] == d)), F.concat(done, F.array(F.struct(s["priority"].alias("priority"), s["step"].alias("step"))))).otherwise(done))
    placed = lists.select(key, F.explode("steps.step").alias("step"), ran.alias("ran"))
    own = F.filter("ran", lambda x: x["step"] == F.col("step"))
    batch = F.array_position(F.array_distinct("ran.priority"), F.get(own, F.lit(0))["priority"]) - 1
    return placed.select(key, "step", batch.cast("int").alias("batch"))


def capped_confidence(stated: Column, generic: Column, specific: Column) -> Column:
    """High needs three specific items and no generic phrase, Medium two."""
    level = F.when(F.lower(stated) == "high", 3).when(F.lower(stated) == "medium", 2).otherwise(1)
    level = F.when((level == 3) & (generic | (specific < 3)), 2).otherwise(level)
    level = F.when((level == 2) & (specific < 2), 1).otherwise(level)
    return F.when(level == 3, "High").when(level == 2, "Medium").otherwise("Low")


def enforced(raw: Column, vocabulary: tuple[str, ...], fallback: str) -> Column:
    """The vocabulary's entry: exact without case, else the first with most shared words of three letters, two at least."""
    low = F.lower(text.collapse_space(raw))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b\w{3,}\b"), F.lit(0)))
    scores = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(set(re.findall(r"\b\w{3,}\b", v.lower())))]))) for v in vocabulary]
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.when(F.lit(False), F.lit(""))
    for v in vocabulary:
        out = out.when(low == v.lower(), v)
    out = out.when(most < 2, fallback)
    for v, s in zip(vocabulary, scores, strict=True):
        out = out.when(s == most, v)
    return out.otherwise(fallback)


def context_text(rows: DataFrame, key: str, order: list[Column], body: Column, most: int) -> DataFrame:
    """Numbered blocks of a key joined in order, each cut to ``most`` characters."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    block = F.concat(F.lit("[V"), F.col("__n").cast("string"), F.lit("] "), F.rtrim(F.substr(body, F.lit(1), F.lit(most))), F.when(F.length(body) > most, "…").otherwise(""))
    listed = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", block.alias("b")))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"))


def page_score(body: Column, has_figure: Column, crops: Column, images: Column) -> Column:
    """4 for a figure word, 3 a crop, 2 an image up to three, 20 times the share of mathematical signs."""
    size = F.length(body)
    share = F.when(size > 0, (size - F.length(F.regexp_replace(body, r"[=+*/^<>∑∫√≤≥±×α-ω]", ""))) / size).otherwise(0.0)
    return F.when(has_figure, 4.0).otherwise(0.0) + 3.0 * crops + 2.0 * F.least(images, F.lit(3)) + 20.0 * share


def key_pages(pages: DataFrame, doc: str, page: str, score: str, most: int = 8) -> DataFrame:
    """First, last and the ``most`` best pages above 0.5 of each document."""
    span = Window.partitionBy(doc)
    ranked = pages.withColumn("__r", F.row_number().over(span.orderBy(F.desc(score), page))).withColumn("__lo", F.min(page).over(span)).withColumn("__hi", F.max(page).over(span))
    return ranked.filter((F.col(page) == F.col("__lo")) | (F.col(page) == F.col("__hi")) | ((F.col("__r") <= most) & (F.col(score) > 0.5))).drop("__r", "__lo", "__hi")


def merged_pages(pages: Column, least: int = 150, most: int = 4000) -> Column:
    """Pages folded into buffers under ``most`` characters; buffers under ``least`` are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(p) < most)
        flushed = F.when((acc["buf"] != "") & (F.length(F.trim(acc["buf"])) >= least), F.concat(acc["out"], F.array(F.trim(acc["buf"])))).otherwise(acc["out"])
        return F.struct(F.when(fits | (acc["buf"] == ""), acc["out"]).otherwise(flushed).alias("out"), F.when(fits, F.concat(acc["buf"], F.lit("\n\n"), p)).otherwise(p).alias("buf"))

    return F.aggregate(pages, start, add, lambda acc: F.when(F.length(F.trim(acc["buf"])) >= least, F.concat(acc["out"], F.array(F.trim(acc["buf"])))).otherwise(acc["out"]))


def source_spread(kept: DataFrame, every: DataFrame, least: int = 2) -> DataFrame:
    """If the kept rows have fewer sources, the best row of each missing source joins until there are enough."""
    have = kept.select("source").distinct()
    best = every.join(have, "source", "left_anti").groupBy("source").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b"))
    missing = F.greatest(F.lit(least) - F.lit(have.limit(least).count()), F.lit(0))
    ranked = best.select(F.col("b.id").alias("id"), "source", F.col("b.score").alias("score")).orderBy(F.desc("score"), "id").limit(least)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # ``least`` rows, no more
    return kept.select("id", "source", "score").unionByName(ranked.withColumn("k", place).filter(F.col("k") <= missing).drop("k"))


def generic(c: Column) -> Column:
    return has_any(F.lower(c), ("state of the art", "good results", "performs well", "promising"))
