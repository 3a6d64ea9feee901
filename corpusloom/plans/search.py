"""Retrieval queries: benchmark passages are asked of documents, and embeddings of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import retrieval as r
from corpusloom.operators.coverage import coverage
from corpusloom.operators.resolution import checkpointed
from corpusloom.plans.works import DOCS_SQL, works_docs
from corpusloom.sources.tables import load


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and the whole text of every benchmark item."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = asked(spark, sf_dir).select("query_id", F.explode(text.tokens_long("query")).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.bm25_topk(texts(spark, sf_dir), text.tokens_long("text"), query_terms(spark, sf_dir), 10)


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.tfidf_topk(texts(spark, sf_dir), text.tokens_long("text"), query_terms(spark, sf_dir), 10)


def minmax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = r.min_max(bm25_topk(spark, sf_dir))
    return scaled.select("query_id", "id", F.round("scaled", 5).alias("scaled"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and tf-idf lists of one query, fused."""
    return r.rrf([r.both_topk(texts(spark, sf_dir), text.tokens_long("text"), query_terms(spark, sf_dir), 10)], 5)


def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: each item asks two variants (first and last half of its words); each is BM25-ranked, then fused by item."""
    base = asked(spark, sf_dir).withColumn("w", F.split("query", " ")).withColumn("half", F.floor(F.size("w") / 2).cast("int"))
    halves = base.select("query_id", F.posexplode(F.array(F.slice("w", F.lit(1), F.col("half")), F.slice("w", F.col("half") + 1, F.size("w")))).alias("v", "words"))
    variants = halves.select((F.col("query_id") * 2 + F.col("v")).alias("query_id"), F.explode(text.tokens_long(F.array_join("words", " "))).alias("term"))
    best = r.bm25_topk(texts(spark, sf_dir), text.tokens_long("text"), variants.groupBy("query_id", "term").agg(F.count("*").alias("qf")), 10)
    return r.rrf([best.withColumn("query_id", F.floor(F.col("query_id") / 2).cast("long"))], 5)


def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.55 of scaled BM25 and 0.45 of scaled tf-idf over the BM25 pool."""
    # ten rows a query, read three times
    pool = checkpointed(r.min_max(bm25_topk(spark, sf_dir), "score", "lexical").select("query_id", "id", "lexical"))
    docs, tokens = texts(spark, sf_dir), text.tokens_long("text")
    # the pool has ten ids a query at most: only their texts become rows of terms
    own = r.term_rows(docs.join(pool.select("id").distinct(), "id", "left_semi"), "id", tokens)
    cosine = r.tfidf_cosine(own, query_terms(spark, sf_dir), pool=pool, corpus=docs.select("id", tokens.alias("tokens")))
    both = r.min_max(pool.join(cosine, ["query_id", "id"], "left").na.fill(0.0, ["score"]), "score", "semantic")
    return r.topk(both.select("query_id", "id", F.round(0.55 * F.col("lexical") + 0.45 * F.col("semantic"), 5).alias("score")), 5)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is asked of all vectors: exact inner products."""
    base = vectors(spark, sf_dir)
    queries = base.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return r.vector_topk(base.select("id", "embedding"), queries, 5)


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label agreement of the vector lists: recall at 5 and reciprocal rank of the first right one, self excluded."""
    base = vectors(spark, sf_dir)
    found = vector_topk(spark, sf_dir).filter("id <> query_id")
    names = base.select(F.col("id").alias("i"), F.col("label").alias("found_label"))
    own = base.select(F.col("id").alias("q"), F.col("label").alias("query_label"))
    judged = found.join(names, found.id == names.i).join(own, found.query_id == own.q)
    per = judged.groupBy("query_id").agg(F.max((F.col("found_label") == F.col("query_label")).cast("int")).alias("hit"), F.min(F.when(F.col("found_label") == F.col("query_label"), F.col("rank"))).alias("first"))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the titles of the ten best documents of each benchmark item cover its words: the first two side by side must be found, those of six letters or more should."""
    titles = works_docs(spark, sf_dir).select("id", "title", "source")
    retrieved = bm25_topk(spark, sf_dir).join(titles, "id").select(F.col("query_id").alias("topic"), "rank", "title", "source")
    words = F.split(F.lower("text"), r"\s+")
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), words.alias("words"))
    must = items.select("topic", F.lit("must").alias("tier"), F.array_join(F.slice("words", 1, 2), " ").alias("keyword"))
    should = items.select("topic", F.lit("should").alias("tier"), F.explode(F.array_distinct(F.filter("words", lambda w: F.length(w) >= 6))).alias("keyword"))
    return coverage(retrieved, must.unionByName(should))


QUERIES = {"keyword_recall": keyword_recall, "bm25_topk": bm25_topk, "tfidf_cosine_topk": tfidf_topk, "minmax_pool": minmax_pool, "rrf_fuse": rrf_fuse, "multi_query_rrf": multi_query_rrf,
           "hybrid_blend": hybrid_blend, "vector_topk": vector_topk, "recall_mrr": recall_mrr}

TERMS = """
tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
terms AS (SELECT id, term, count(*) AS tf FROM tok WHERE length(term) > 2 GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM terms GROUP BY id),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
base AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
QT = """qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM {src}) WHERE length(term) > 2 GROUP BY ALL)"""
BM = """bm AS (SELECT query_id, id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (avgdl + 1e-9)) + 1e-9)), 6) AS score
  FROM qt JOIN terms USING (term) JOIN df USING (term) JOIN dl USING (id), tot GROUP BY ALL),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10)"""
TI = """idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, tot),
dw AS (SELECT id, term, tf / dl * idf AS w FROM terms JOIN idf USING (term) JOIN dl USING (id)),
dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY id),
qw AS (SELECT query_id, term, qf / sum(qf) OVER (PARTITION BY query_id) * coalesce(idf, ln(n + 1) + 1) AS qw FROM qt LEFT JOIN idf USING (term), tot),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY query_id),
ti AS (SELECT query_id, id, round(least(greatest(sum(w * qw) / (any_value(norm) * any_value(qnorm)), 0), 1), 6) AS score FROM dw JOIN qw USING (term) JOIN dn USING (id) JOIN qn USING (query_id) GROUP BY query_id, id),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ti) WHERE rank <= 10)"""
ONE = f"WITH {TERMS}, {QT.format(src='base')}, {BM}"
VEC = """q AS (SELECT vec_id AS query_id, embedding AS query, label AS query_label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, query_label, vec_id AS id, label, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(query[i] AS DOUBLE))), 6) AS score FROM embeddings, q),
vk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5)"""

ORACLES = {
    "bm25_topk": f"{ONE} SELECT query_id, id, score, rank FROM bk",
    "tfidf_cosine_topk": f"{ONE}, {TI} SELECT query_id, id, score, rank FROM tk",
    "minmax_pool": f"""{ONE} SELECT query_id, id, round(CASE WHEN max(score) OVER p - min(score) OVER p < 1e-9 THEN 0.5 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p + 1e-9) END, 5) AS scaled
        FROM bk WINDOW p AS (PARTITION BY query_id)""",
    "rrf_fuse": f"""{ONE}, {TI}, u AS (SELECT query_id, id, rank FROM bk UNION ALL SELECT query_id, id, rank FROM tk), f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5""",
    "multi_query_rrf": f"""WITH {TERMS}, variants AS (SELECT query_id * 2 AS query_id, array_to_string(string_split(query, ' ')[1:len(string_split(query, ' ')) // 2], ' ') AS query FROM base
        UNION ALL SELECT query_id * 2 + 1, array_to_string(string_split(query, ' ')[len(string_split(query, ' ')) // 2 + 1:], ' ') FROM base), {QT.format(src='variants')}, {BM},
        f AS (SELECT query_id // 2 AS query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM bk GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5""",
    "hybrid_blend": f"""{ONE}, {TI}, p AS (SELECT bk.query_id, bk.id, bk.score AS a, coalesce(ti.score, 0) AS c FROM bk LEFT JOIN ti ON bk.query_id = ti.query_id AND bk.id = ti.id),
        m AS (SELECT query_id, id, CASE WHEN max(a) OVER w - min(a) OVER w < 1e-9 THEN 0.5 ELSE (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w + 1e-9) END AS x,
          CASE WHEN max(c) OVER w - min(c) OVER w < 1e-9 THEN 0.5 ELSE (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w + 1e-9) END AS y FROM p WINDOW w AS (PARTITION BY query_id)),
        f AS (SELECT query_id, id, round(0.55 * x + 0.45 * y, 5) AS score FROM m)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5""",
    "keyword_recall": f"""{ONE}, {DOCS_SQL}, re AS (SELECT query_id AS topic, rank, title, source FROM bk JOIN docs USING (id)), it AS (SELECT item_id AS topic, regexp_split_to_array(lower(text), '\\s+') AS ws FROM benchmark),
        kw AS (SELECT topic, 'must' AS tier, array_to_string(ws[1:2], ' ') AS keyword FROM it UNION ALL SELECT topic, 'should', unnest(list_distinct(list_filter(ws, lambda w: length(w) >= 6))) FROM it),
        fi AS (SELECT kw.topic, tier, keyword, min(rank) AS first FROM kw LEFT JOIN re ON re.topic = kw.topic AND contains(trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' '), trim(regexp_replace(lower(keyword), '[^a-z0-9 ]', '', 'g'), ' ')) GROUP BY ALL),
        by_topic AS (SELECT topic, {', '.join(f"count(*) FILTER (tier = '{t}') AS {t}_n, count(first) FILTER (tier = '{t}') AS {t}_found, coalesce(sum(1.0 / first) FILTER (tier = '{t}'), 0) AS {t}_rr" for t in ('must', 'should'))} FROM fi GROUP BY topic),
        si AS (SELECT topic, count(*) AS n_retrieved FROM re GROUP BY topic), so AS (SELECT topic, count(DISTINCT trim(s, ' ')) AS n_sources FROM (SELECT topic, unnest(string_split(source, ',')) AS s FROM re) WHERE trim(s, ' ') <> '' GROUP BY topic)
        SELECT topic, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_sources, 0) AS n_sources, {', '.join(f"{t}_n, {t}_found, round(coalesce(100.0 * {t}_found / nullif({t}_n, 0), 100.0), 1) AS {t}_recall, round(coalesce({t}_rr / nullif({t}_n, 0), 0.0), 3) AS {t}_mrr" for t in ('must', 'should'))},
          round(coalesce(100.0 * (must_found + should_found) / nullif(must_n + should_n, 0), 100.0), 1) AS total_recall FROM by_topic LEFT JOIN si USING (topic) LEFT JOIN so USING (topic)""",
    "vector_topk": f"WITH {VEC} SELECT query_id, id, score, rank FROM vk",
    "recall_mrr": f"""WITH {VEC}, j AS (SELECT query_id, max(CAST(label = query_label AS INT)) AS hit, min(CASE WHEN label = query_label THEN rank END) AS first FROM vk WHERE id <> query_id GROUP BY query_id)
        SELECT count(*) AS n_queries, round(avg(hit), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM j""",
}
