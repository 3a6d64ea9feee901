"""Entities and relations from plain text by rule: capitalised runs, and runs joined by a verb.

It stands where a language model would extract both at once, and gives rows in the form that the graph operators take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.graphs import SEED_STOP

WORD = r"[\p{L}\p{N}_-]"
RUN = rf"\p{{Lu}}{WORD}*(?: \p{{Lu}}{WORD}*)*"
BEFORE = r"(?:^|[^\p{L}\p{N}_-])"
VERBS = "uses|use|improves|outperforms|extends|contains|requires|is based on|is|are|was|were|est|sont|ist|sind|war|es|son"
ARTICLES = "a|an|the|un|une|le|la|les|el|los|der|die|das|ein|eine"
MENTION = rf"{BEFORE}({RUN})"
CLAIM = rf"{BEFORE}({RUN}) (?:{WORD}+ ){{0,3}}?({VERBS}) (?:(?:{ARTICLES}) )?(\p{{L}}{WORD}*(?: \p{{Lu}}{WORD}*)*)"
#: Kinds of names by a word that they end with or are.
KINDS = (("Metric", ("accuracy", "bleu", "rouge", "f1", "auc", "map", "perplexity")), ("Dataset", ("dataset", "corpus", "benchmark", "glue", "squad")),
         ("Model", ("model", "network", "transformer", "encoder", "decoder")), ("Method", ("method", "algorithm", "attention", "learning")))


def kind_of(name: Column) -> Column:
    last = F.lower(F.regexp_extract(name, r"([^ ]*)$", 1))
    out = F.lit("Concept")
    for kind, words in reversed(KINDS):
        out = F.when(last.isin(*words), kind).otherwise(out)
    return out


def mentions(sentences: DataFrame) -> DataFrame:
    """(pos, name) of sentences (id, pos, sentence): every capitalised run, without lone question and function words. pos is a struct of id, pos and number."""
    found = sentences.select("id", "pos", F.posexplode(F.regexp_extract_all("sentence", F.lit(MENTION), F.lit(1))).alias("k", "name"))
    return found.filter(~F.lower("name").isin(*SEED_STOP)).select(F.struct("id", "pos", "k").alias("pos"), "name")


def entities(sentences: DataFrame) -> DataFrame:
    """(pos, name, type) of every mention."""
    return mentions(sentences).select("pos", "name", kind_of(F.col("name")).alias("type"))


def end_mentions(sentences: DataFrame) -> DataFrame:
    """``entities`` with only the first and the last mention of each name: first and last ones of any group of names are among them."""
    ends = mentions(sentences).groupBy("name").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("pos"), "name", kind_of(F.col("name")).alias("type"))


def relations(sentences: DataFrame) -> DataFrame:
    """(pos, head, head_type, relation, tail, tail_type, evidence): a capitalised run, up to three words, a verb, and what follows it without its article."""
    found = sentences.select("id", "pos", "sentence", F.posexplode(F.regexp_extract_all("sentence", F.lit(CLAIM), F.lit(0))).alias("k", "claim"))
    # a claim by itself has the parts that it has in its sentence: the sentence is searched once
    part = lambda g: F.regexp_extract("claim", CLAIM, g)
    rows = found.select("id", "pos", "k", part(1).alias("head"), part(2).alias("verb"), part(3).alias("tail"), F.col("sentence").alias("evidence"))
    rows = rows.filter(~F.lower("head").isin(*SEED_STOP) & ~F.lower("tail").isin(*SEED_STOP))
    return rows.select(F.struct("id", "pos", "k").alias("pos"), "head", kind_of(F.col("head")).alias("head_type"), text.relation_type("verb").alias("relation"), "tail", kind_of(F.col("tail")).alias("tail_type"), "evidence")


def first_relations(sentences: DataFrame) -> DataFrame:
    """(pos, head, relation, tail, evidence): ``relations`` with only the first of those that are equal."""
    return relations(sentences).groupBy("head", "relation", "tail").agg(F.min("pos").alias("pos"), F.min_by("evidence", "pos").alias("evidence"))
