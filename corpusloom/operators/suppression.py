"""Greedy suppression of near equal strings: in order, each is kept unless a kept one before it is too similar.

Similarity is by position: the share of places of the longer string where both have the
same character. Equal strings are settled first, by group; for the rest only pairs that
share one of their first aligned segments meet, which loses none, and the greedy choice
is made in rounds over those pairs: what has no undecided one before it is kept, and what
a kept one is similar to goes. Strings that one row holds as a list are decided in that row.
"""

from __future__ import annotations

from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.resolution import checkpointed

#: Characters of an aligned segment, and strings up to this length are suppressed by equals only.
SEGMENT, SHORT = 5, 10


def positional_similarity(a: Column, b: Column) -> Column:
    """Equal characters at equal places over the greater length."""
    chars = lambda c: F.split(c, "")
    same = F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    return F.aggregate(same, F.lit(0), lambda t, x: t + x) / F.greatest(F.length(a), F.length(b))


def similar_pairs(rows: DataFrame, key: list[str], floor: float = 0.9) -> DataFrame:
    """(key, a, b) with place a < b of distinct strings (key, place, norm) whose similarity is greater than ``floor``.

    Similar strings of n and m <= n places differ in less than (1 - floor) * n places, so of their first
    (1 - floor) * n + 1 segments one is equal; each has that many, as SEGMENT is less than half of 1 / (1 - floor).
    """
    long = rows.filter(F.length("norm") > SHORT)
    segments = F.floor(F.length("norm") / floor * (1 - floor)) + 1
    parts = long.select(*key, "place", "norm", F.explode(F.sequence(F.lit(0), (segments - 1).cast("int"))).alias("k"))
    parts = parts.withColumn("part", F.expr(f"substring(norm, k * {SEGMENT} + 1, {SEGMENT})")).filter(F.length("part") == SEGMENT)
    right = parts.select(*key, "k", "part", F.col("place").alias("b"), F.col("norm").alias("norm_b"))
    met = parts.withColumnRenamed("place", "a").join(right, [*key, "k", "part"])
    met = met.filter((F.col("a") < F.col("b")) & (F.least(F.length("norm"), F.length("norm_b")) > floor * F.greatest(F.length("norm"), F.length("norm_b"))))
    once = met.groupBy(*key, "a", "b").agg(F.first("norm").alias("norm"), F.first("norm_b").alias("norm_b"))
    return once.filter(positional_similarity(F.col("norm"), F.col("norm_b")) > floor).select(*key, "a", "b")


def suppressed(rows: DataFrame, key: list[str], text: str, confidence: str, place: str, floor: float = 0.9) -> DataFrame:
    """The rows that are kept: in each key, by falling confidence and then ``place`` (unique in a key), those not similar to one kept before.

    Strings are compared in lower case without white space; equal ones are duplicates, and those of more than SHORT characters also
    when more than ``floor`` of their places are equal. A null text is an empty string.
    """
    order = F.struct((-F.col(confidence)).alias("less"), F.col(place).alias("pos"))
    ranked = rows.select(*key, compared(F.col(text)).alias("norm"), order.alias("place"))
    first = checkpointed(ranked.groupBy(*key, "norm").agg(F.min("place").alias("place")))
    pairs = checkpointed(similar_pairs(first, key, floor))
    dropped = first.select(*key, "place").limit(0)
    # each round decides the first open string of every key, at least
    while not pairs.isEmpty():
        later = pairs.select(*key, F.col("b").alias("a")).distinct()
        heads = pairs.join(later, [*key, "a"], "left_anti")
        lost = checkpointed(heads.select(*key, F.col("b").alias("place")).distinct())
        open_pairs = pairs.join(heads.select(*key, "a").distinct(), [*key, "a"], "left_anti")
        for end in ("a", "b"):
            open_pairs = open_pairs.join(lost.withColumnRenamed("place", end), [*key, end], "left_anti")
        pairs = checkpointed(open_pairs)
        dropped = checkpointed(dropped.union(lost))
    kept = first.join(dropped, [*key, "place"], "left_anti").select(*key, F.col("place.pos").alias(place))
    return rows.join(kept, [*key, place], "left_semi")


def unlike(norms: list[str], floor: float) -> list[int]:
    """The numbers of the strings, in order, that are like none kept before them. Only strings with an equal one of those segments that ``similar_pairs`` explodes are compared."""
    seen, by_segment, kept = set(), {}, []
    for i, norm in enumerate(norms):
        if norm in seen:
            continue
        seen.add(norm)
        n = len(norm)
        if n > SHORT:
            segments = [(k, norm[k : k + SEGMENT]) for k in range(0, (int(n / floor * (1 - floor)) + 1) * SEGMENT, SEGMENT) if k + SEGMENT <= n]
            near = {s for at in segments for s in by_segment.get(at, ()) if min(len(s), n) > floor * max(len(s), n)}
            if any(sum(map(eq, s, norm)) / max(len(s), n) > floor for s in near):
                continue
            for at in segments:
                by_segment.setdefault(at, []).append(norm)
        kept.append(i)
    return kept


def suppressed_list(norms: Column, floor: float = 0.9) -> Column:
    """The numbers of those strings of a list, in its order, that ``suppressed`` keeps: nothing is shuffled. Strings are as it compares them."""

    @F.arrow_udf("array<int>")
    def kept(lists: pa.Array) -> pa.Array:
        return pa.array([unlike(own.as_py(), floor) if own.is_valid else None for own in lists], pa.list_(pa.int32()))

    return kept(norms)


def compared(text: Column) -> Column:
    """Lower case without white space; a null text is an empty string."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
