"""Rule classification of queries and scope filters, as ordered CASE chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.bibliometrics import has_any

# Intent patterns.
INTENTS = {
    "wants_survey": r"\b(survey|review\s+paper|literature\s+review|overview\s+of|state\s+of\s+the\s+art)\b",
    "wants_seminal": r"\b(classic|seminal|foundational|landmark|canonical|must-read|influential\s+paper)\b",
    "wants_recent": r"\b(recent|latest|new|newest|sota|state-of-the-art|2023|2024|2025|2026)\b",
    "wants_implementation": r"\b(code|implementation|github|pytorch|tensorflow|jax|open\s*source|reproduce)\b",
    "wants_benchmark": r"\b(benchmarks?|dataset|leaderboard|evaluation|comparison|versus|vs\.?)\b",
    "wants_theory": r"\b(theory|theorem|proof|convergence|bound|optimization\s+landscape)\b",
    "wants_application": r"\b(application|real-world|deployment|clinical|industry|production)\b",
}
# Parent topics, first match wins.
PARENT_RULES = (
    (("neural", "deep", "convolutional", "recurrent", "transformer", "attention", "lstm"), "deep learning"),
    (("language model", "nlp", "text", "translation", "summarization", "tokeniz"), "natural language processing"),
    (("reinforcement", "policy", "reward", "agent", "markov", "q-learning", "actor"), "reinforcement learning"),
    (("image", "vision", "visual", "segmentation", "detection", "recognition"), "computer vision"),
    (("graph", "node", "edge", "link prediction"), "graph machine learning"),
    (("generative", "diffusion", "synthesis", "sampling"), "generative models"),
    (("quantum", "qubit", "circuit", "entanglement"), "quantum computing"),
    (("federated", "privacy", "differential privacy", "distributed learning"), "federated learning"),
    (("continual", "catastrophic", "forgetting", "lifelong"), "continual learning"),
    (("meta", "few-shot", "zero-shot", "learning to learn"), "meta-learning"),
    (("bayesian", "uncertainty", "probabilistic", "posterior"), "probabilistic machine learning"),
    (("topological", "homology", "manifold", "geometric", "persistent"), "topological/geometric learning"),
    (("protein", "drug", "genomics", "molecular", "biology"), "computational biology"),
    (("fairness", "bias", "ethical", "explainability", "interpretability"), "responsible AI"),
    (("retrieval", "search", "information retrieval", "dense retrieval"), "information retrieval"),
)
# Words that do not count for a query's complexity.
COMPLEXITY_STOP = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "with", "by", "is", "are", "via", "using")
# Subject scope by category prefix and by tag.
ALLOWED_PREFIXES = ("cs.", "eess.", "stat.ml")
BLOCKED_PREFIXES = ("q-bio.", "physics.", "cond-mat.", "quant-ph", "astro-ph", "nucl-th", "nucl-ex", "hep-", "gr-qc", "nlin.", "econ.", "q-fin.", "math-ph")
BLOCKED_TAGS = (
    "biology", "biological sciences", "biochemistry", "genetics", "genomics", "proteomics", "neuroscience", "ecology", "zoology", "botany", "medicine", "clinical",
    "immunology", "pharmacology", "pathology", "oncology", "cardiology", "surgery", "nursing", "psychiatry", "agronomy", "forestry", "marine biology", "virology",
    "microbiology", "cell biology", "molecular biology", "physiology", "anatomy", "dermatology", "astrophysics", "geology", "atmospheric science", "soil science", "veterinary")
ALLOWED_TAGS = (
    "computer science", "computing", "transformer", "deep learning", "reinforcement learning", "neural network", "graph neural", "computer engineering",
    "software engineering", "electrical engineering", "electronic engineering", "telecommunications", "signal processing", "control system", "systems engineering",
    "information technology", "human computer interaction", "human–computer interaction", "theoretical computer science", "machine learning", "artificial intelligence",
    "data science", "world wide web", "internet", "computer network", "database", "operating systems", "computer programming", "programming language",
    "computer graphics", "computer vision", "natural language processing", "robotics", "embedded systems", "parallel computing", "distributed computing",
    "cloud computing", "high performance computing", "computer security", "cryptography", "algorithms", "software systems")


def intents(query: Column) -> dict[str, Column]:
    return {name: query.rlike(f"(?i){pattern}") for name, pattern in INTENTS.items()}


def complexity(query: Column) -> Column:
    words = F.filter(F.split(F.lower(F.trim(query)), r"[\s\-_]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*COMPLEXITY_STOP))
    n = F.size(words)
    return F.when(F.contains(query, F.lit('"')), "narrow").when(n <= 2, "broad").when(n <= 4, "moderate").otherwise("narrow")


def parent_topic(query: Column) -> Column:
    low = F.lower(query)
    out = F.when(F.lit(False), F.lit(""))
    for words, parent in PARENT_RULES:
        out = out.when(has_any(low, words), parent)
    return out.otherwise("machine learning")


def variant_cap(level: Column, fan_out: bool) -> Column:
    broad, moderate, narrow = (2, 4, 5) if fan_out else (1, 2, 3)
    return F.when(level == "broad", broad).when(level == "moderate", moderate).otherwise(narrow)


def in_scope(category: Column, tags: Column, sources: Column) -> Column:
    """Whether a record is in scope; category, tags and sources are lower case, category may be null."""
    any_prefix = lambda prefixes: F.coalesce(F.expr("false") | _starts(category, prefixes), F.lit(False))
    joined = F.array_join(tags, "\n")
    blocked, allowed = has_any(joined, BLOCKED_TAGS), has_any(joined, ALLOWED_TAGS)
    arxiv, openalex = F.array_contains(sources, "arxiv"), F.array_contains(sources, "openalex")
    return (F.when(any_prefix(BLOCKED_PREFIXES), False)
            .when(any_prefix(ALLOWED_PREFIXES), ~blocked)
            .when((F.size(tags) > 0) & blocked, False)
            .when((F.size(tags) > 0) & allowed, True)
            .when(F.size(tags) > 0, arxiv)
            .when(arxiv, True).when(openalex, False).otherwise(True))


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(text, F.lit(p))
    return out


# Element query patterns and keywords.
CROSS = r"relation.*between|how.*relate|connection.*between|link.*between"
COMPARE = (r"compare\s+(equation|table|figure)s?\s+(\d+)\s+(?:and|with)\s+(\d+)", r"difference\s+between\s+(equation|table|figure)s?\s+(\d+)\s+and\s+(\d+)")
LIST_ALL = (r"(?:show|list|display|extract)\s+all\s+(equation|table|figure)s?", r"how many\s+(equation|table|figure)s?", r"all\s+(?:the\s+)?(equation|table|figure)s?")
SPECIFIC = {"equation": r"\b(?:equation|eq\.?|formula)\s+(\d+)\b", "table": r"\b(?:table|tbl\.?)\s+(\d+)\b", "figure": r"\b(?:figure|fig\.?)\s+(\d+)\b"}
KEYWORDS = {
    "equation": ("equation", "formula", "mathematical", "calculation", "expression", "variable", "function", "latex"),
    "table": ("table", "data", "results", "statistics", "values", "columns", "rows", "dataset", "comparison"),
    "figure": ("figure", "image", "diagram", "graph", "plot", "chart", "illustration", "visualization", "picture"),
}


def hits(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def element_intent(rows: DataFrame, query: str) -> DataFrame:
    """Adds query_type, target_type, target_number and confidence of a question about document elements.

    The patterns are evaluated once, in a step of their own, so that the CASE chains stay small.
    """
    low = F.lower(F.trim(query))
    found = lambda pats: F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in pats])
    votes = F.array(*[hits(low, w) for w in KEYWORDS.values()])
    parts = rows.withColumn("__q", F.struct(low.alias("low"), low.rlike(CROSS).alias("cross"), found(COMPARE).alias("compared"), found(LIST_ALL).alias("listed"),
                                            *[found([p]).alias(k) for k, p in SPECIFIC.items()], votes.alias("votes")))
    at = lambda name: F.col(f"__q.{name}")
    first = F.array_position(at("votes"), F.array_max(at("votes")).cast("int")).cast("int")
    named = F.coalesce(*[F.when(at(k).isNotNull(), F.lit(k)) for k in SPECIFIC])
    voted = F.when(F.array_max(at("votes")) > 0, F.element_at(F.array(*[F.lit(k) for k in KEYWORDS]), first))
    kind = (F.when(at("low") == "", "general").when(at("cross"), "cross_reference").when(at("compared").isNotNull(), "comparison").when(at("listed").isNotNull(), "list_all")
            .when(named.isNotNull(), "specific_element").otherwise(F.coalesce(voted, F.lit("general"))))
    typed = parts.withColumn("query_type", kind).withColumn("target_type", F.when((at("low") != "") & ~at("cross"), F.coalesce(at("compared"), at("listed"), named, voted)))
    typed = typed.withColumn("target_number", F.when(F.col("query_type") == "specific_element", F.coalesce(*[at(k) for k in SPECIFIC]).cast("int")))
    known = F.when(at("low") == "", 0.5)
    for value, names in ((0.9, ["cross_reference"]), (0.95, ["comparison"]), (1.0, ["list_all", "specific_element"]), (0.7, ["general"])):
        known = known.when(F.col("query_type").isin(names), value)
    return typed.withColumn("confidence", known.otherwise(0.8)).drop("__q")
