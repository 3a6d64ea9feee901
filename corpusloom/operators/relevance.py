"""Lexical and topic relevance of records to expanded queries, and the composite's title terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.bibliometrics import has_any

# Venue hints, generic phrases, words that are no evidence.
VENUES = ("cs.cl", "cs.lg", "cs.cv", "machine learning", "neurips", "iclr", "icml")
GENERIC = ("deep learning", "neural network", "artificial intelligence")
STOP = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "with", "by", "is", "are", "was", "be", "via", "from", "using", "based", "towards", "over")


def count_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))


def best_of(values: list[Column]) -> Column:
    return reduce(lambda a, b: F.greatest(a, b), values, F.lit(0.0))


def strength(title_norm: Column, phrase: str) -> Column:
    return text.anchor_strength(title_norm, F.lit(_norm(phrase)))


def _norm(phrase: str) -> str:
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", phrase.lower())).strip()


def step(value: Column, high: float, middle: float, low: float) -> Column:
    return F.when(value >= 0.95, high).when(value >= 0.4, middle).when(value > 0, low).otherwise(0.0)


def tokens_of(keywords: list[str]) -> list[str]:
    """Words of the keywords and initials of three letters or more, without stop words."""
    out: set[str] = set()
    for k in keywords:
        words = k.lower().split()
        out |= set(words)
        letters = "".join(w[0] for w in words if w not in STOP)
        if len(letters) >= 3:
            out.add(letters)
    return sorted(out - set(STOP))


def lexical(title: Column, body: Column, queries: list[str], keywords: list[str]) -> Column:
    """Five tiers: landmark title, query in title, query in body, keyword words in title and in body; a bonus and a penalty.

    ``body`` is the lower-cased abstract and tags. Not limited above.
    """
    if not queries and not keywords:
        return F.lit(0.0)
    low, norm = F.lower(title), text.title_spaced(title)
    hits = count_of([F.contains(body, F.lit(k.lower())) for k in keywords])
    halved = F.when(hits >= 2, 1.0).otherwise(0.5)
    long = [q for q in queries if len(_norm(q).split()) >= 4]
    first = step(strength(norm, queries[0]), 0.70, 0.48, 0.30) * halved if queries and queries[0] in long else F.lit(0.0)
    second = F.when(first < 0.60, best_of([step(strength(norm, q), 0.60, 0.42, 0.28) for q in long]) * halved).otherwise(0.0)
    in_title = (first > 0) | (second > 0)
    third = F.when((first + second < 0.50) & has_any(body, tuple(q.lower() for q in queries if q)), 0.40).otherwise(0.0)
    words = tokens_of(keywords)
    share = (count_of([F.contains(low, F.lit(w)) for w in words]) / len(words) * 0.35 + count_of([F.contains(body, F.lit(w)) for w in words]) / len(words) * 0.30) if words else F.lit(0.0)
    bonus = F.when(has_any(low, tuple(k.lower() for k in keywords if len(k.split()) > 1)), 0.10).otherwise(0.0)
    penalty = F.when(in_title & (hits == 0), 0.15).otherwise(0.0)
    return F.bround(F.greatest(first + second + third + share + bonus - penalty, F.lit(0.0)), 4)


def topic(title: Column, abstract: Column, tags: Column, venue: Column, profile: dict, queries: list[str], keywords: list[str]) -> Column:
    """0.30 title + 0.30 abstract + 0.20 tags + 0.05 venue + 0.10 landmark + 0.05 acronym - penalties; inputs are lower case."""
    norm = text.title_spaced(title)
    whole = F.concat_ws(" ", title, abstract, tags, venue)
    aliases = tuple(a.lower() for a in profile.get("aliases", []) if a)
    strengths = [strength(norm, q) for q in queries if len(_norm(q).split()) >= 4]
    terms = [t.lower() for t in [*keywords, *profile.get("subtopics", []), *profile.get("methods", [])] if t]
    phrase, tagged, titled = [], [], []
    for t in terms:
        as_phrase = F.contains(whole, F.lit(t)) if len(t.split()) >= 2 else F.lit(False)
        phrase.append(as_phrase)
        tagged.append(~as_phrase & F.contains(tags, F.lit(t)))
        titled.append(~as_phrase & ~F.contains(tags, F.lit(t)) & (F.contains(title, F.lit(t)) if len(t) >= 3 else F.lit(False)))
    some = lambda flags: reduce(lambda a, b: a | b, flags, F.lit(False))
    title_signal = best_of([F.when(has_any(title, aliases), 1.0).otherwise(0.0), *[step(s, 0.95, 0.62, 0.48) for s in strengths], F.when(some(titled), 0.55).otherwise(0.0)])
    abstract_signal = F.when(has_any(abstract, aliases) | some(phrase), 1.0).otherwise(0.0)
    tag_signal = F.when(has_any(tags, aliases) | some(tagged), 1.0).otherwise(0.0)
    quoted = [F.contains(abstract, F.lit(q.lower())) & ((strength(norm, q) if len(_norm(q).split()) >= 4 else F.lit(0.0)) < 0.42) for q in queries if len(q.split()) >= 3]
    landmark = best_of([*[step(s, 1.0, 0.52, 0.28) for s in strengths], F.when(some(quoted), 0.38).otherwise(0.0)])
    acronym = F.when(F.lit(bool(profile.get("acronym"))) & whole.rlike(rf"\b\Q{profile.get('acronym', '').lower()}\E\b"), 1.0).otherwise(0.0)
    venue_signal = F.when(has_any(venue, VENUES), 0.4).otherwise(0.0)
    excluded = tuple(x.lower() for x in profile.get("exclusions", []))
    penalty = F.when(has_any(title, excluded), 0.15).when(has_any(abstract, excluded), 0.10).otherwise(0.0)
    weak = title_signal + abstract_signal + tag_signal + landmark + acronym < 0.5
    penalty = penalty + F.when(weak & has_any(whole, GENERIC), 0.22).otherwise(0.0)
    total = 0.30 * title_signal + 0.30 * abstract_signal + 0.20 * tag_signal + 0.05 * venue_signal + 0.10 * landmark + 0.05 * acronym - penalty
    return F.bround(F.greatest(total, F.lit(0.0)), 4)


def blended(topic_score: Column, lexical_score: Column, sources: Column, failed: tuple[str, ...] = ()) -> Column:
    """0.72 topic + 0.28 lexical up to 1; more for several sources, less when all of them failed."""
    base = F.bround(F.least(F.lit(1.0), 0.72 * topic_score + 0.28 * lexical_score), 4)
    more = F.when(F.size(sources) > 1, F.least(F.lit(1.0), base + 0.05)).otherwise(base)
    lost = F.size(F.array_except(sources, F.array(*[F.lit(s) for s in failed]).cast("array<string>"))) == 0
    return F.when((F.size(sources) > 0) & lost, F.greatest(more - 0.04, F.lit(0.0))).otherwise(more)


def title_gate(topic_score: Column) -> Column:
    """How much of the title's boosts a record's topic evidence lets through."""
    return F.when(topic_score >= 0.5, 1.0).when(topic_score >= 0.3, 0.5 + (topic_score - 0.3) / 0.2 * 0.5).otherwise(0.3)


def landmark_boost(title: Column, keywords: list[str]) -> Column:
    norm = text.title_spaced(title)
    return best_of([step(strength(norm, k), 5.0, 1.15, 0.45) for k in keywords if len(_norm(k).split()) >= 4])


def concept_boost(title: Column, query: str) -> Column:
    """More for a concept in the title's first word, less where it is a tool."""
    q = query.lower().strip()
    if len(q) <= 3:
        return F.lit(0.0)
    low = F.lower(title)
    first = F.when(F.contains(F.get(F.split(low, " "), F.lit(0)), F.lit(q)), 0.25).otherwise(0.0)
    return first - F.when(has_any(low, (f"using {q}", f"with {q}", f"based on {q}", f"for {q}")), 0.15).otherwise(0.0)


def exclusion_factor(cosine: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 0.15 * cosine))


def rerank_blend(base: Column, signal: Column, in_pool: Column, beta: float = 0.28) -> Column:
    return F.when(in_pool, (1 - beta) * base + beta * signal).otherwise(base)
