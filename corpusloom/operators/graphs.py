"""Property-graph operators on vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text

FULL_ABBR = r"^(.+?)\s*\(([A-Z][A-Z0-9\-]{1,12})\)\s*$"
ABBR_FULL = r"^([A-Z][A-Z0-9\-]{1,12})\s*\((.+?)\)\s*$"
# Words that seed no lookup.
SEED_STOP = ("what", "which", "where", "when", "how", "why", "who", "does", "did", "the", "and", "but", "for", "are", "was", "were", "with", "that", "this", "from", "have", "has", "been", "its", "they", "their",
             "about", "into", "over", "more", "some", "than", "then", "each", "both", "also", "can", "could", "would", "should", "not", "any", "all", "other", "used", "use", "using", "give", "tell", "explain",
             "describe", "list", "show", "find", "get", "make", "take")


def keep_node(name: Column) -> Column:
    """No empty, one-character or numeric-only names."""
    trimmed = F.trim(name)
    return (F.length(trimmed) > 1) & ~trimmed.rlike(r"^\d+(\.\d+)?$")


def aliases(names: DataFrame) -> DataFrame:
    """(alias, canonical): parenthesised forms first (the last one wins), then initials of a full name (the first one wins)."""
    rows = names.select("pos", F.trim("name").alias("name"))
    fa, af = (lambda g: F.regexp_extract("name", FULL_ABBR, g)), (lambda g: F.regexp_extract("name", ABBR_FULL, g))
    first = rows.withColumn("full", F.trim(F.when(fa(1) != "", fa(1)).otherwise(af(2)))).withColumn("abbr", F.trim(F.when(fa(1) != "", fa(2)).otherwise(af(1))))
    inline = first.filter((F.col("full") != "") & (F.length("abbr") >= 2) & (text.initials("full") == F.upper("abbr")))
    forms = inline.select("pos", "full", F.explode(F.array(F.lower("abbr"), F.lower("name"))).alias("alias"))
    rule1 = forms.groupBy("alias").agg(F.max_by("full", "pos").alias("canonical"))
    short = rows.filter(F.col("name").rlike(r"^[A-Z][A-Z0-9\-]{1,12}$")).select(F.lower("name").alias("alias"), F.upper("name").alias("key")).distinct()
    long = rows.filter(F.size(F.split("name", r"\s+")) >= 2).select("pos", "name", text.initials("name").alias("key"))
    rule2 = short.join(long, "key").groupBy("alias").agg(F.min_by("name", "pos").alias("canonical"))
    return rule1.unionByName(rule2.join(rule1, "alias", "left_anti"))


def canonical_entities(entities: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Entities by canonical name and type, the first of each."""
    clean = entities.filter(F.trim("name") != "").filter(~F.trim("name").rlike(r"^\d+(\.\d+)?$")).select("pos", F.trim("name").alias("name"), F.coalesce(text.blank_to_null("type"), F.lit("Concept")).alias("type"))
    named = clean.join(alias_map, F.lower("name") == alias_map["alias"], "left").select("pos", F.coalesce("canonical", "name").alias("name"), "type")
    return named.groupBy(F.lower("name").alias("key"), "type").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos")).drop("key")


def canonical_relations(relations: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Relations with canonical ends and types, the first of each (head, type, tail)."""
    a, b = alias_map.select(F.col("alias").alias("ha"), F.col("canonical").alias("hc")), alias_map.select(F.col("alias").alias("ta"), F.col("canonical").alias("tc"))
    rows = relations.select("pos", F.trim("head").alias("head"), text.relation_type("relation").alias("relation"), F.trim("tail").alias("tail"), "evidence").filter("head <> '' and tail <> ''")
    rows = rows.join(a, F.lower("head") == a.ha, "left").join(b, F.lower("tail") == b.ta, "left")
    rows = rows.select("pos", F.coalesce("hc", "head").alias("head"), "relation", F.coalesce("tc", "tail").alias("tail"), "evidence")
    keys = [F.lower("head").alias("h"), F.lower("tail").alias("t"), "relation"]
    return rows.groupBy(*keys).agg(F.min_by("head", "pos").alias("head"), F.min_by("tail", "pos").alias("tail"), F.min_by("evidence", "pos").alias("evidence"), F.min("pos").alias("pos")).drop("h", "t")


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at the end of an edge, ids compared without case."""
    ends = edges.select(F.lower("src").alias("e")).union(edges.select(F.lower("dst").alias("e"))).distinct()
    return nodes.join(ends, F.lower("id") == ends.e, "left_semi")


def two_hops(edges: DataFrame, seeds: DataFrame, limit: int = 60) -> DataFrame:
    """Triples within two undirected steps of nodes whose name holds a seed, in order; seeds are few and counted."""
    both = edges.select("src", "rel", "dst", F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(edges.select("src", "rel", "dst", F.col("dst").alias("at"), F.col("src").alias("to")))
    small = F.broadcast(seeds) if seeds.count() <= 10_000 else seeds
    names = both.select("at").distinct()
    start = names.join(small, F.contains(F.lower("at"), F.lower("seed")), "left_semi")
    one = both.join(start, "at", "left_semi")
    reached = one.select(F.col("to").alias("at")).union(start).distinct()
    return both.join(reached, "at", "left_semi").select("src", "rel", "dst").distinct().orderBy("src", "rel", "dst").limit(limit)


def seed_terms(question: Column) -> Column:
    """Quoted phrases, capitalised runs, then words of four letters or more; the first of each without case, twelve at most."""
    quoted = F.regexp_extract_all(question, F.lit('"([^"]+)"'), F.lit(1))
    runs = F.regexp_extract_all(question, F.lit(r"\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+)*\b"), F.lit(0))
    words = F.filter(F.regexp_extract_all(question, F.lit(r"\b[a-zA-Z][a-zA-Z0-9\-]{3,}\b"), F.lit(0)), lambda w: ~F.lower(w).isin(*SEED_STOP))
    every = F.concat(quoted, runs, words)
    low = F.transform(every, F.lower)
    first = F.filter(F.transform(every, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.slice(first, 1, 12)


def pairs_of(tokens: Column) -> Column:
    """Neighbouring tokens as one string each."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(1))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def overlap_rerank(query: Column, context: Column, score: Column, is_graph: Column) -> Column:
    """score + 0.6 unigram Jaccard + 0.4 bigram Jaccard + 0.05 for a graph fact."""
    q, c = text.tokens_space(query), text.tokens_space(context)

    def share(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))

    bi = F.when(F.size(q) > 1, share(pairs_of(q), pairs_of(c))).otherwise(0.0)
    return score + share(q, c) * 0.6 + bi * 0.4 + F.when(is_graph, 0.05).otherwise(0.0)


def in_order(rows: DataFrame, key: str, pos: str, value: Column, sep: str, name: str) -> DataFrame:
    """Values of a key joined in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), value.alias("v")))), lambda s: s["v"]), sep).alias(name))


def last_valid(turns: DataFrame, key: str, order: str, valid: Column, most: int) -> DataFrame:
    ranked = turns.filter(valid).withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.filter(F.col("back") <= most)
