"""Numeric and vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def dot(a: Column, b: Column) -> Column:
    """Inner product in DOUBLE, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def recency(date: Column, as_of: str) -> Column:
    """exp(-0.000379 days), 0 without a date."""
    day = F.try_to_date(date)
    days = F.greatest(F.datediff(F.lit(as_of).cast("date"), day), F.lit(0))  # greatest() skips nulls
    return F.when(day.isNotNull(), F.exp(-0.000379 * days)).otherwise(0.0)


def citation_raw(cites: Column) -> Column:
    return F.when(cites > 0, F.least(F.log1p(cites) / F.log1p(F.lit(1000.0)), F.lit(1.0))).otherwise(0.0)


def citation_blended(cites: Column, date: Column, as_of_year: int, blend: float) -> Column:
    """log1p of citations blended with log1p of citations a year."""
    year = F.when(F.substring(date, 1, 4).rlike("^[0-9]{4}$"), F.substring(date, 1, 4).cast("int"))
    a_year = cites / (F.greatest(F.lit(as_of_year) - year, F.lit(0)) + 0.5)
    scaled = F.when((cites > 0) & year.isNotNull(), F.least(F.log1p(a_year) / F.log1p(F.lit(500.0)), F.lit(1.0))).otherwise(0.0)
    share = F.when(F.length(date) >= 4, F.lit(blend)).otherwise(0.0)
    return (1 - F.coalesce(share, F.lit(0.0))) * citation_raw(cites) + F.coalesce(share, F.lit(0.0)) * scaled


# Confidence of each source.
SOURCE_CONFIDENCE = {"arxiv": 0.85, "semantic_scholar": 0.95, "openalex": 0.9}


def source_confidence(source: Column, table: dict[str, float] | None = None, default: float = 0.5) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (table or SOURCE_CONFIDENCE).items() for x in pair])
    parts = F.filter(F.transform(F.split(F.lower(source), ","), lambda x: F.trim(x)), lambda s: s != "")
    return F.coalesce(F.array_max(F.transform(parts, lambda s: F.coalesce(known[s], F.lit(default)))), F.lit(default))


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt))


def share_of(text: Column, pattern: str) -> Column:
    """Share of the characters that match the pattern."""
    size = F.length(text)
    return F.when(size > 0, (size - F.length(F.regexp_replace(text, pattern, ""))) / size).otherwise(0.0)
