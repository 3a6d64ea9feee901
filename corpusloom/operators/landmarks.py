"""Curated records of a topic: by its name, else by a name that holds it or that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.automaton import term_hits


def topic_keys(topics: DataFrame, keys: DataFrame) -> DataFrame:
    """(topic_id, name, key): for each topic (topic_id, topic) the key (key, place) of its trimmed lower-case name, else the first in place that is part of the name or has it as a part.

    Both ways of containment are one pass each over the texts, for all names and keys together. A null or empty topic is part of every key; topics without a key are left out.
    """
    asked = topics.select("topic_id", F.lower(F.trim(F.coalesce("topic", F.lit("")))).alias("name"))
    names = asked.select("name").distinct()
    held = term_hits(names, "name", "name", keys.select(F.col("key").alias("needle"))).select("name", F.col("needle").alias("key"))
    holding = term_hits(keys.select("key").distinct(), "key", "key", names.select(F.col("name").alias("needle"))).select(F.col("needle").alias("name"), "key")
    near = held.unionByName(holding).join(keys.select("key", "place"), "key")
    best = near.groupBy("name").agg(F.min_by("key", F.struct((F.col("key") != F.col("name")).alias("other"), "place")).alias("key"))
    return asked.join(best, "name").select("topic_id", "name", "key")


def landmarks(topics: DataFrame, records: DataFrame) -> DataFrame:
    """(topic_id, id, title, citations): the records (key, place, title, score) of each topic's key, in order of place, with citations made of their score."""
    keys = records.groupBy("key").agg(F.min("place").alias("place"))
    found = topic_keys(topics, keys).join(records.withColumnRenamed("place", "own_place"), "key")
    listed = found.groupBy("topic_id", "name").agg(F.sort_array(F.collect_list(F.struct("own_place", "title", "score"))).alias("all")).select("topic_id", "name", F.posexplode("all").alias("k", "r"))
    made = F.concat(F.lit("local-"), F.replace("name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("k") + 1).cast("string"))
    return listed.select("topic_id", made.alias("id"), F.col("r.title").alias("title"), F.floor(2000 * F.coalesce("r.score", F.lit(1.0)) + 1000).alias("citations"))
