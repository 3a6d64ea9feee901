"""Coverage of ranked results by keywords: recall, first ranks and spread by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.automaton import term_hits

TIERS = ("must", "should")


def normal(c: Column) -> Column:
    """Lower case, ASCII letters, digits and blanks only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def keyword_ranks(retrieved: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, tier, keyword, first): the rank of the first title of the topic that holds the keyword, or null.

    ``retrieved`` has topic, rank and title, ``keywords`` topic, tier and keyword. Each distinct title is read once for
    all keywords of all topics. A keyword that is empty without its marks is held by every title.
    """
    titles = retrieved.select("topic", "rank", normal(F.col("title")).alias("title"))
    asked = keywords.select("topic", "tier", "keyword", normal(F.col("keyword")).alias("needle"))
    hits = term_hits(titles.select("title").distinct(), "title", "title", asked)
    first = titles.join(hits, "title").groupBy("topic", "needle").agg(F.min("rank").alias("first"))
    return asked.join(first, ["topic", "needle"], "left").select("topic", "tier", "keyword", "first")


def coverage(retrieved: DataFrame, keywords: DataFrame) -> DataFrame:
    """For each topic with keywords: n_retrieved, n_sources, and by tier n, found, recall in percent (one decimal) and mean reciprocal rank (three); recall of both.

    A tier without keywords has a recall of 100 and a mean reciprocal rank of 0. ``source`` may name several, with commas between.
    """
    ranks = keyword_ranks(retrieved, keywords)
    one = lambda tier: F.col("tier") == tier
    by_topic = ranks.groupBy("topic").agg(
        *[F.count_if(one(t)).alias(f"{t}_n") for t in TIERS], *[F.count_if(one(t) & F.col("first").isNotNull()).alias(f"{t}_found") for t in TIERS],
        *[F.coalesce(F.sum(F.when(one(t), 1.0 / F.col("first"))), F.lit(0.0)).alias(f"{t}_rr") for t in TIERS],
    )
    names = F.explode(F.split("source", ",")).alias("name")
    sources = retrieved.select("topic", names).select("topic", F.trim("name").alias("name")).filter("name <> ''").groupBy("topic").agg(F.countDistinct("name").alias("n_sources"))
    sizes = retrieved.groupBy("topic").agg(F.count("*").alias("n_retrieved"))
    share = lambda a, b: F.round(F.coalesce(100.0 * a / F.nullif(b, F.lit(0)), F.lit(100.0)), 1)
    n, found = F.col("must_n") + F.col("should_n"), F.col("must_found") + F.col("should_found")
    out = by_topic.join(sizes, "topic", "left").join(sources, "topic", "left")
    tiers = [c for t in TIERS for c in (F.col(f"{t}_n"), F.col(f"{t}_found"), share(F.col(f"{t}_found"), F.col(f"{t}_n")).alias(f"{t}_recall"), F.round(F.coalesce(F.col(f"{t}_rr") / F.nullif(F.col(f"{t}_n"), F.lit(0)), F.lit(0.0)), 3).alias(f"{t}_mrr"))]
    zero = F.lit(0).cast("long")
    return out.select("topic", F.coalesce("n_retrieved", zero).alias("n_retrieved"), F.coalesce("n_sources", zero).alias("n_sources"), *tiers, share(found, n).alias("total_recall"))
