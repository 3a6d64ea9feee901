"""Graph queries: supplier, part, customer and nation names as entities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graphs as g
from corpusloom.plans.records import QUERY_SQL, query_texts
from corpusloom.sources.tables import load


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, name, type): brands in full, in brackets and as initials, with names that do not count."""
    part = load(spark, sf_dir, "part")
    words = F.initcap(F.concat_ws(" ", "p_name", F.lower("p_type")))
    short = F.upper(F.array_join(F.transform(F.split(words, " "), lambda w: F.substring(w, 1, 1)), ""))
    name = (F.when(F.col("p_partkey") % 4 == 0, F.concat(words, F.lit(" ("), short, F.lit(")"))).when(F.col("p_partkey") % 4 == 1, short)
            .when(F.col("p_partkey") % 4 == 2, words).otherwise(F.when(F.col("p_size") % 2 == 0, "28.4").otherwise(words)))
    return part.select(F.col("p_partkey").alias("pos"), name.alias("name"), F.when(F.col("p_size") % 3 == 0, "Model").otherwise("Concept").alias("type"))


ENT_SQL = r"""words AS (SELECT p_partkey AS pos, p_size, array_to_string(list_transform(string_split(concat(p_name, ' ', lower(p_type)), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS fulln FROM part),
sh AS (SELECT *, array_to_string(list_transform(string_split(fulln, ' '), lambda w: upper(w[1])), '') AS short FROM words),
ent AS (SELECT pos, CASE pos % 4 WHEN 0 THEN fulln || ' (' || short || ')' WHEN 1 THEN short WHEN 2 THEN fulln ELSE CASE WHEN p_size % 2 = 0 THEN '28.4' ELSE fulln END END AS name,
  CASE WHEN p_size % 3 = 0 THEN 'Model' ELSE 'Concept' END AS type FROM sh),
inl AS (SELECT pos, trim(regexp_extract(name, '^(.+?)\s*\(([A-Z][A-Z0-9\-]{1,12})\)\s*$', 1)) AS fulln, regexp_extract(name, '^(.+?)\s*\(([A-Z][A-Z0-9\-]{1,12})\)\s*$', 2) AS abbr, name FROM ent),
r1 AS (SELECT alias, max_by(fulln, pos) AS canonical FROM (SELECT pos, fulln, unnest([lower(abbr), lower(name)]) AS alias FROM inl
  WHERE fulln <> '' AND array_to_string(list_transform(regexp_split_to_array(fulln, '[\s\-]+'), lambda w: upper(w[1])), '') = upper(abbr) AND length(abbr) >= 2) GROUP BY alias),
r2 AS (SELECT lower(s.name) AS alias, min_by(l.name, l.pos) AS canonical FROM (SELECT DISTINCT name FROM ent WHERE regexp_full_match(name, '[A-Z][A-Z0-9\-]{1,12}')) s
  JOIN ent l ON len(string_split(l.name, ' ')) >= 2 AND array_to_string(list_transform(regexp_split_to_array(l.name, '[\s\-]+'), lambda w: upper(w[1])), '') = s.name
  WHERE lower(s.name) NOT IN (SELECT alias FROM r1) GROUP BY ALL),
al AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = entities(spark, sf_dir)
    lines = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    pair = lines.join(named.select(F.col("pos").alias("l_partkey"), "name"), "l_partkey")
    return pair.select((F.col("l_suppkey") * 100_000 + F.col("l_partkey")).alias("pos"), F.col("name").alias("head"), F.lit("supplied by").alias("relation"),
                       F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 20).cast("string")).alias("tail"), F.concat(F.lit("lines: "), F.col("n")).alias("evidence"))


REL_SQL = """rel AS (SELECT l_suppkey * 100000 + l_partkey AS pos, name AS head, 'supplied by' AS relation, 'Supplier ' || (l_suppkey % 20) AS tail, 'lines: ' || count(*) AS evidence
  FROM lineitem JOIN ent ON l_partkey = ent.pos GROUP BY l_suppkey, l_partkey, name)"""


def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.aliases(entities(spark, sf_dir))


def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities(spark, sf_dir)
    return g.canonical_entities(rows, g.aliases(rows)).select("name", "type", "pos")


def relation_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.canonical_relations(relations(spark, sf_dir), alias_map(spark, sf_dir)).select("head", "relation", "tail", "evidence", "pos")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier - nation - region and customer - nation, names in mixed case."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    supplier, customer = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    in_nation = lambda t, name, key: t.join(F.broadcast(nation), F.col(key) == nation.n_nationkey).select(F.col(name).alias("src"), F.lit("IN_NATION").alias("rel"), F.lower("n_name").alias("dst"))  # noqa: E731  25 nations
    up = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("src"), F.lit("IN_REGION").alias("rel"), F.col("r_name").alias("dst"))
    return in_nation(supplier, "s_name", "s_nationkey").unionByName(in_nation(customer, "c_name", "c_nationkey")).unionByName(up)


EDGE_SQL = """edges AS (SELECT s_name AS src, 'IN_NATION' AS rel, lower(n_name) AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
  SELECT c_name, 'IN_NATION', lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'IN_REGION', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers that an edge of a supplier touches; the others are dropped."""
    nation, supplier = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    nodes = nation.select(F.col("n_name").alias("id"), F.lit("nation").alias("kind")).unionByName(supplier.select(F.col("s_name").alias("id"), F.lit("supplier").alias("kind")))
    return g.incident(nodes.filter(g.keep_node(F.col("id"))), edges(spark, sf_dir).filter("src like 'Supplier%'"))


def two_hop_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("supplier#000000003",), ("region_1",)], "seed string")
    return g.two_hops(edges(spark, sf_dir), seeds)


def seed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_texts(spark, sf_dir).select("query_id", F.posexplode(g.seed_terms(F.col("query"))).alias("pos", "seed"))
    return rows.filter("seed is not null")


def bigram_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that share two words side by side with a query, reranked; those with a comma count as facts. The six best of each query."""
    queries = query_texts(spark, sf_dir)
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("context"))

    def side_by_side(rows: DataFrame, key: str, body: str) -> DataFrame:
        words = F.filter(F.split(F.lower(body), r"\s+"), lambda w: w != "")
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return rows.select(key, F.explode(F.array_distinct(pairs)).alias("pair")).filter("pair is not null")

    met = side_by_side(queries, "query_id", "query").join(side_by_side(items, "item_id", "context"), "pair").select("query_id", "item_id").distinct()
    pairs = met.join(queries, "query_id").join(items, "item_id")
    scored = pairs.select("query_id", "item_id", F.round(g.overlap_rerank(F.col("query"), F.col("context"), F.lit(0.0), F.contains("context", F.lit(","))), 6).alias("score"))
    from corpusloom.operators.bibliometrics import ranked_prefix

    return ranked_prefix(scored, ["query_id"], [F.desc("score"), F.col("item_id")], 6)


QUERIES = {"alias_map": alias_map, "entity_dedup": entity_dedup, "relation_remap": relation_remap, "isolated_nodes": isolated_nodes, "two_hop_facts": two_hop_facts, "seed_terms": seed_terms, "jaccard_bigram_rerank": bigram_rerank}

SPACE = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"
ORACLES = {
    "alias_map": f"WITH {ENT_SQL} SELECT alias, canonical FROM al",
    "entity_dedup": f"""WITH {ENT_SQL}, n AS (SELECT pos, coalesce(canonical, name) AS name, type FROM ent LEFT JOIN al ON lower(name) = alias WHERE name <> '28.4')
        SELECT min_by(name, pos) AS name, type, min(pos) AS pos FROM n GROUP BY lower(name), type""",
    "relation_remap": f"""WITH {ENT_SQL}, {REL_SQL}, n AS (SELECT pos, coalesce(a.canonical, head) AS head, upper(replace(relation, ' ', '_')) AS relation, coalesce(b.canonical, tail) AS tail, evidence
        FROM rel LEFT JOIN al a ON lower(head) = a.alias LEFT JOIN al b ON lower(tail) = b.alias)
        SELECT min_by(head, pos) AS head, relation, min_by(tail, pos) AS tail, min_by(evidence, pos) AS evidence, min(pos) AS pos FROM n GROUP BY lower(head), lower(tail), relation""",
    "isolated_nodes": f"""WITH {EDGE_SQL}, e AS (SELECT lower(src) AS x FROM edges WHERE src LIKE 'Supplier%' UNION SELECT lower(dst) FROM edges WHERE src LIKE 'Supplier%'),
        n AS (SELECT n_name AS id, 'nation' AS kind FROM nation UNION ALL SELECT s_name, 'supplier' FROM supplier) SELECT id, kind FROM n WHERE lower(id) IN (SELECT x FROM e)""",
    "two_hop_facts": f"""WITH {EDGE_SQL}, u AS (SELECT *, src AS loc, dst AS t FROM edges UNION ALL SELECT *, dst, src FROM edges),
        s AS (SELECT DISTINCT loc FROM u WHERE contains(lower(loc), 'supplier#000000003') OR contains(lower(loc), 'region_1')), r AS (SELECT t AS loc FROM u WHERE loc IN (SELECT loc FROM s) UNION SELECT loc FROM s)
        SELECT DISTINCT src, rel, dst FROM u WHERE loc IN (SELECT loc FROM r) ORDER BY src, rel, dst LIMIT 60""",
    "seed_terms": f"""WITH {QUERY_SQL.replace('qs AS', 'q0 AS')}, qs AS (SELECT query_id, regexp_replace(query, '[^\\x00-\\x7F]', '_', 'g') AS query FROM q0), l AS (SELECT query_id, list_concat(list_concat(regexp_extract_all(query, '"([^"]+)"', 1), regexp_extract_all(query, '\\b[A-Z][A-Za-z0-9\\-]+(?:\\s+[A-Z][A-Za-z0-9\\-]+)*\\b')),
          list_filter(regexp_extract_all(query, '\\b[a-zA-Z][a-zA-Z0-9\\-]{{3,}}\\b'), lambda w: lower(w) NOT IN ({', '.join(repr(x) for x in g.SEED_STOP)}))) AS ws FROM qs),
        e AS (SELECT query_id, unnest(ws) AS seed, unnest(range(0, len(ws))) AS p FROM l), f AS (SELECT query_id, min_by(seed, p) AS seed, min(p) AS p FROM e GROUP BY query_id, lower(seed)),
        n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS INT) AS pos, seed FROM f) SELECT query_id, pos, seed FROM n WHERE pos < 12""",
    "jaccard_bigram_rerank": f"""WITH {QUERY_SQL}, t AS (SELECT query_id, {SPACE.format(c='query')} AS q FROM qs), i AS (SELECT item_id, contains(text, ',') AS fact, {SPACE.format(c='text')} AS c FROM benchmark),
        b AS (SELECT *, list_distinct(list_transform(range(1, len(q)), lambda k: q[k] || ' ' || q[k + 1])) AS qb, list_distinct(list_transform(range(1, len(c)), lambda k: c[k] || ' ' || c[k + 1])) AS cb FROM t, i),
        s AS (SELECT query_id, item_id, round(0.6 * len(list_intersect(list_distinct(q), list_distinct(c))) / greatest(len(list_distinct(list_concat(q, c))), 1)
          + 0.4 * (CASE WHEN len(q) > 1 THEN len(list_intersect(qb, cb)) / greatest(len(list_distinct(list_concat(qb, cb))), 1) ELSE 0 END) + CASE WHEN fact THEN 0.05 ELSE 0 END, 6) AS score FROM b WHERE len(list_intersect(qb, cb)) > 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 6""",
}
