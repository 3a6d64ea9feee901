"""A graph from the documents' own text: entities and relations extracted by rule, then made canonical and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import extraction as ex
from corpusloom.operators import graphs as g
from corpusloom.operators.resolution import checkpointed
from corpusloom.plans.documents import SENT_SQL, sentences
from corpusloom.plans.graphs import ENT_SQL


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last mention of each name, taken from the texts once."""
    return checkpointed(ex.end_mentions(sentences(spark, sf_dir)))


def entities_of(found: DataFrame) -> DataFrame:
    return g.canonical_entities(found, g.aliases(found))


def relations_of(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.canonical_relations(ex.first_relations(sentences(spark, sf_dir)), g.aliases(found))


def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of each kind in all documents, short forms under their full name, with the document that has them first."""
    return entities_of(names(spark, sf_dir)).select("name", "type", F.col("pos.id").alias("first_id"))


def text_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = relations_of(names(spark, sf_dir), spark, sf_dir)
    return made.select("head", "relation", "tail", F.md5("evidence").alias("evidence_md5"), F.col("pos.id").alias("first_id"))


def text_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that some relation has as an end."""
    found = names(spark, sf_dir)
    ends = relations_of(found, spark, sf_dir).select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    nodes = entities_of(found).select(F.col("name").alias("id"), "type")
    # the ends are read twice
    return g.incident(nodes.filter(g.keep_node(F.col("id"))), checkpointed(ends))


QUERIES = {"text_entities": text_entities, "text_relations": text_relations, "text_incident": text_incident}

_STOP = ", ".join("'" + s + "'" for s in g.SEED_STOP)
_KIND = "CASE " + " ".join(f"WHEN lower(regexp_extract({{0}}, '([^ ]*)$', 1)) IN ({', '.join(chr(39) + x + chr(39) for x in words)}) THEN '{kind}'" for kind, words in ex.KINDS) + " ELSE 'Concept' END"
_ALIASES = ENT_SQL[ENT_SQL.index("inl AS (") :]
TEXT_SQL = f"""{SENT_SQL},
m0 AS (SELECT id, pos AS spos, unnest(regexp_extract_all(sentence, '{ex.MENTION}', 1)) AS name, unnest(range(0, len(regexp_extract_all(sentence, '{ex.MENTION}', 1)))) AS k FROM sents),
ent AS (SELECT {{'id': id, 'pos': spos, 'k': k}} AS pos, name, {_KIND.format('name')} AS type FROM m0 WHERE lower(name) NOT IN ({_STOP})),
{_ALIASES},
ce AS (SELECT coalesce(canonical, name) AS name, type, pos FROM ent LEFT JOIN al ON lower(name) = alias WHERE NOT regexp_full_match(name, '\\d+(\\.\\d+)?')),
en AS (SELECT min_by(name, pos) AS name, type, min(pos) AS pos FROM ce GROUP BY lower(name), type),
c0 AS (SELECT id, pos AS spos, sentence, regexp_extract_all(sentence, '{ex.CLAIM}', 1) AS hs, regexp_extract_all(sentence, '{ex.CLAIM}', 2) AS vs, regexp_extract_all(sentence, '{ex.CLAIM}', 3) AS ts FROM sents),
c1 AS (SELECT id, spos, sentence, unnest(hs) AS head, unnest(vs) AS verb, unnest(ts) AS tail, unnest(range(0, len(hs))) AS k FROM c0),
c2 AS (SELECT {{'id': id, 'pos': spos, 'k': k}} AS pos, coalesce(a.canonical, head) AS head, replace(upper(verb), ' ', '_') AS relation, coalesce(b.canonical, tail) AS tail, sentence FROM c1 LEFT JOIN al a ON lower(head) = a.alias LEFT JOIN al b ON lower(tail) = b.alias
  WHERE lower(head) NOT IN ({_STOP}) AND lower(tail) NOT IN ({_STOP})),
re AS (SELECT min_by(head, pos) AS head, relation, min_by(tail, pos) AS tail, min_by(sentence, pos) AS evidence, min(pos) AS pos FROM c2 GROUP BY lower(head), lower(tail), relation)"""
ORACLES = {
    "text_entities": f"WITH {TEXT_SQL} SELECT name, type, pos.id AS first_id FROM en",
    "text_relations": f"WITH {TEXT_SQL} SELECT head, relation, tail, md5(evidence) AS evidence_md5, pos.id AS first_id FROM re",
    "text_incident": f"WITH {TEXT_SQL}, ends AS (SELECT lower(head) AS e FROM re UNION SELECT lower(tail) FROM re) SELECT name AS id, type FROM en WHERE length(trim(name, ' ')) > 1 AND lower(name) IN (SELECT e FROM ends)",
}
