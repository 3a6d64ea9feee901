"""Checks and corrections of responses against an element registry, and consistency of verdicts with their evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators import evidence as e
from corpusloom.operators.bibliometrics import has_any

TYPES = ("equation", "table", "figure")
WARNING = "\n\n⚠️ **Note:** Some information in this response may be uncertain."
# Hedges (the capital one is kept as it is, so it never meets lower-cased text), what a claim and what an absence sounds like, and words that name no paper.
HEDGES = ("might be", "could be", "possibly", "perhaps", "I think", "it seems", "probably")
ASSERTIVE = r"(?i)\b(demonstrates|achieves|shows|significantly|outperforms|introduces|provides|establishes|confirms|supports|enables|allows|offers|delivers|proves)\b"
ABSENT = r"(?i)\b(does not|not mention|not report|not provide|not release|no code|no checkpoint|insufficient|missing|absent|unclear|not evaluated|limited information)\b"
METRIC = r"(?i)\b\d[\d.]*\s*(%|f1|accuracy|bleu|rouge|auc|map|score|point)\b"
CLAIMED = r"(?i)\b(composed of|is a stack|consists of|performs|achieves|introduces|uses|employs|applies|demonstrates|shows|reports)\b"
NEUTRAL = "The extracted paper text does not provide sufficient evidence to support a confident verdict for this dimension."
TITLE_STOP = ("the", "and", "for", "with", "from", "into", "using", "novel", "architecture", "model", "language", "understanding", "sequence", "paper")
RELEASED = ("code", "checkpoint", "github", "repository", "open-source")
DENIED = ("not", "no ", "without", "missing", "absent")


def references(text: Column, kind: str) -> Column:
    """Numbers of the elements of a kind that the text names, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b{kind}\s+(\d+)"), F.lit(1)), lambda n: n.cast("int"))


def nearest(known: Column, number: Column) -> Column:
    """The known number next to this one, the smaller of two."""
    return F.array_min(F.transform(known, lambda k: F.struct(F.abs(k - number).alias("d"), k.alias("k"))))["k"]


def unknown_references(text: Column, known: Column) -> Column:
    """(wrong, right) names of the elements that the text names and the registry lacks, by kind and place."""
    def changes(name: str, found: Column) -> Column:
        lost = F.filter(F.array_distinct(found), lambda n: ~F.array_contains(known, n))
        return F.transform(lost, lambda n: F.struct(F.concat(F.lit(name), n.cast("string")).alias("wrong"), F.concat(F.lit(name), nearest(known, n).cast("string")).alias("right")))

    return F.concat(*[changes(f"{kind.capitalize()} ", references(text, kind)) for kind in TYPES])


def mixed_types(text: Column, kind: Column) -> Column:
    """Whether a response to a question of one kind names elements of another."""
    named = {k: F.size(references(text, k)) > 0 for k in TYPES}
    out = F.lit(False)
    for k in TYPES:
        others = F.lit(False)
        for o in TYPES:
            others = others if o == k else others | named[o]
        out = out | ((kind == k) & others)
    return F.coalesce(out, F.lit(False))


def ungrounded(text: Column, source: Column) -> Column:
    """More than two hedges, or more than three of the first ten numbers are not in the source."""
    low = F.lower(text)
    hedges = F.lit(0)
    for h in HEDGES:
        hedges = hedges + F.contains(low, F.lit(h)).cast("int")
    every = lambda c: F.regexp_extract_all(c, F.lit(r"\b\d+\.?\d*\b"), F.lit(0))
    lost = F.filter(F.slice(every(text), 1, 10), lambda n: (F.length(n) > 2) & ~F.array_contains(every(source), n))
    return (hedges > 2) | (F.size(lost) > 3)


def repetitive(text: Column) -> Column:
    """More than five sentences of which fewer than seven in ten differ."""
    own = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.lower(F.trim(s))), lambda s: F.length(s) > 10)
    return (F.size(own) > 5) & (F.size(F.array_distinct(own)) < F.size(own) * 0.7)


def corrected(text: Column, changes: Column, warn: Column) -> Column:
    """The text with each wrong name replaced, one after the other, and a note where asked for."""
    out = F.aggregate(changes, text, lambda acc, c: F.replace(acc, c["wrong"], c["right"]))
    return F.when(warn, F.concat(out, F.lit(WARNING))).otherwise(out)


def consistent(verdict: Column, rationale: Column, evidence: Column, confidence: Column) -> dict[str, Column]:
    """A verdict without enough evidence has no claim in its rationale, no metric in its evidence and Low confidence; a positive one with words of absence is not High."""
    nee = verdict == "Not enough evidence"
    return {
        "rationale": F.when(nee & rationale.rlike(ASSERTIVE), NEUTRAL).otherwise(rationale),
        "evidence": F.when(nee, F.filter(evidence, lambda x: ~x.rlike(METRIC))).otherwise(evidence),
        "confidence": F.when(nee, "Low").when(rationale.rlike(ABSENT) & (confidence == "High"), "Low").otherwise(confidence),
    }


def without_claims(evidence: Column) -> Column:
    """Evidence of a negative verdict without claims, unless nothing were left."""
    kept = F.filter(evidence, lambda x: ~x.rlike(CLAIMED))
    return F.when(F.size(kept) > 0, kept).otherwise(evidence)


def identity_tokens(title: Column) -> Column:
    """Acronyms, and the first six long words in order, of a title."""
    raw = F.regexp_extract_all(title, F.lit(r"\b[A-Za-z][A-Za-z0-9-]{2,}\b"), F.lit(0))
    acronyms = F.transform(F.filter(raw, lambda t: F.upper(t) == t), lambda t: F.lower(t))
    long = F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda t: F.lower(t)), lambda t: (F.length(t) >= 5) & ~t.isin(*TITLE_STOP))))
    return F.array_sort(F.array_union(acronyms, F.slice(long, 1, 6)))


def reproducibility(found: Column, evidence: Column) -> Column:
    """A sentence on the signal groups that are there, one on those missing, one if no release is told of."""
    every = F.array(*[F.lit(k) for k in sorted(e.REPRO_SIGNALS)])
    absent = F.array_except(every, found)
    told = F.exists(evidence, lambda x: has_any(F.lower(x), RELEASED) & ~has_any(F.lower(x), DENIED))
    parts = F.array_compact(F.array(F.when(F.size(found) > 0, F.concat(F.lit("Reproducibility signals present: "), F.array_join(F.array_sort(found), ", "), F.lit("."))),
                                    F.when(F.size(absent) > 0, F.concat(F.lit("Missing signals: "), F.array_join(F.array_sort(absent), ", "), F.lit("."))), F.when(~told, "No code or checkpoint release is mentioned in the extracted text.")))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("Partial reproducibility evidence found in the extracted text.")
