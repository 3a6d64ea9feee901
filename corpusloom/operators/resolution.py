"""Entity resolution: equal keys and prefix-filtered similarity give links, links give clusters, clusters one record.

Links are stars to the least record of a key, never all pairs of a group, and the title
join meets only titles that share one of their first tokens in rare-first order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.folders import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def key_links(rows: DataFrame, key: str) -> DataFrame:
    """(a, b): every record to the least one with its key."""
    held = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), "id")
    least = held.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").select("k", "a")
    return held.join(least, "k").filter("id <> a").select("a", F.col("id").alias("b"))


def title_links(rows: DataFrame, tokens: str, threshold: float = 0.88) -> DataFrame:
    """(a, b) of token sets at or above the Jaccard threshold, each distinct set once; lossless by prefix filter.

    Sets meet by a word of their heads only if their sizes are in the same or a neighbouring band (a band is as wide as sizes of a pair can
    differ), and if what stands after the word, their first one in common, is enough.
    """
    sets = checkpointed(rows.filter(F.size(tokens) > 0).groupBy(F.array_sort(tokens).alias("tokens")).agg(F.min("id").alias("id")))
    words = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    often = words.groupBy("t").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    band = F.floor(F.log("n") / (math.log(1 / threshold) * 1.000001)).cast("int")
    head = words.join(often, "t").select("id", "t", place.alias("k"), "n", band.alias("band")).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    head = checkpointed(head)
    other = head.select(F.col("id").alias("b"), "t", F.col("n").alias("m"), F.col("k").alias("l"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    enough = 1 + F.least(F.col("n") - F.col("k"), F.col("m") - F.col("l")) >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9
    near = head.join(other, ["t", "band"]).filter((F.col("id") < F.col("b")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9) & enough).select(F.col("id").alias("a"), "b").distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    share = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return near.join(left, "a").join(right, "b").filter(share >= threshold).select("a", "b")


def clusters(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): the least id that links reach; labels spread and jump until nothing changes."""
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("cluster")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("cluster").alias("m"))
        low = labels.join(near, labels.id == near.a).select("id", F.col("cluster").alias("was"), F.least("cluster", "m").alias("cluster"))
        top = labels.select(F.col("id").alias("i"), F.col("cluster").alias("t"))
        moved = checkpointed(low.join(top, low.cluster == F.col("i"), "left").select("id", "was", F.least("cluster", F.coalesce("t", "cluster")).alias("cluster")))
        labels = moved.select("id", "cluster")
        if moved.filter("was <> cluster").isEmpty():
            return rows.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def merged(rows: DataFrame, clustered: DataFrame) -> DataFrame:
    """One record a cluster: most citations win, the longest abstract, first identifiers, all sources in order."""
    every = rows.join(clustered, "id")
    rank = F.struct(-F.col("citations"), F.col("id"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
    return every.groupBy("cluster").agg(
        F.count("*").alias("members"), F.max("citations").alias("citations"), first("title"), first("doi"),
        F.max_by(F.col("abstract"), F.struct(F.length("abstract"), F.col("citations"), -F.col("id"))).alias("abstract"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"))
