"""Lexical and vector retrieval for many queries at once.

Terms are long rows (doc, term, tf); the query side is a small table of terms. Corpus
statistics are one aggregation, and only the documents that share a term with a query
enter the join, which the engine broadcasts where the query side is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import mathx
from corpusloom.operators.best import bm25_best, held_best, lexical_best, vector_best
from corpusloom.operators.bibliometrics import ranked_prefix

K1 = 1.5
B = 0.75
RRF_K = 60


def term_rows(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf) rows."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(terms: DataFrame, key: str) -> DataFrame:
    return terms.groupBy(key).agg(F.sum("tf").alias("dl"))


def bm25(terms: DataFrame, query_terms: DataFrame, key: str = "id") -> DataFrame:
    """query_id, key, score for documents with a query term; a repeated query term adds again (column qf).

    Only document frequencies of query terms are taken; N and the mean length are one row.
    """
    size = lengths(terms, key)
    totals = size.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    asked = query_terms.select("term").distinct()
    hit = terms.join(asked, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    weight = hit.join(df, "term").join(size, key).crossJoin(F.broadcast(totals))  # one row
    idf = F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("avgdl") + 1e-9)) + 1e-9)
    scored = weight.select(key, "term", (idf * part).alias("w"))
    return scored.join(query_terms, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("w") * F.col("qf")), 6).alias("score"))


def bm25_topk(docs: DataFrame, tokens: Column, query_terms: DataFrame, k: int, bonus: Callable | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best of ``bm25`` over documents with a row for each integer ``id``, scored where they are read; see ``bm25_best``."""
    found = bm25_best(docs, tokens, query_terms, k, K1, B, bonus)
    return topk(found.select("query_id", "id", F.round("raw", 6).alias("score")), k)


def tfidf_cosine(terms: DataFrame, query_terms: DataFrame, key: str = "id", pool: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """query_id, key, score: cosine of tf-idf vectors with idf = ln((N+1)/(df+1)) + 1.

    A document's length divides its weights and its norm alike, so counts serve for both. The terms meet their idf
    in one shuffle; norms and products are sums over that. With a ``pool`` of (query_id, key) pairs only those are
    scored: document frequencies are of all documents, but only terms of documents in the pool are weighted. With ``corpus``, a row (key, tokens) for each document, those frequencies
    are taken from its lists, added up before the shuffle, and ``terms`` needs no more than the documents to score.
    """
    if corpus is None:
        n = terms.select(key).distinct().agg(F.count("*").alias("N"))
        df = terms.groupBy("term").agg(F.count("*").alias("df"))
    else:
        n = corpus.filter("size(tokens) > 0").agg(F.count("*").alias("N"))
        df = corpus.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row
    wanted = terms if pool is None else terms.join(pool.select(key).distinct(), key, "left_semi")
    weighted = wanted.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = query_terms.withColumn("ql", F.sum("qf").over(Window.partitionBy("query_id")))
    unseen = n.select((F.log(F.col("N") + 1) + 1).alias("idf0"))
    qw = asked.join(idf, "term", "left").crossJoin(F.broadcast(unseen)).select("query_id", "term", (F.col("qf") / F.col("ql") * F.coalesce("idf", "idf0")).alias("qw"))
    qnorm = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    met = weighted.join(qw, "term") if pool is None else weighted.join(pool.select("query_id", key).distinct(), key).join(qw, ["query_id", "term"])
    dots = met.groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("qw")).alias("d"))
    return dots.join(norms, key).join(qnorm, "query_id").select("query_id", key, F.round(mathx.clamp(F.col("d") / (F.col("norm") * F.col("qnorm")), 0.0, 1.0), 6).alias("score"))


def tfidf_topk(docs: DataFrame, tokens: Column, query_terms: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k best of ``tfidf_cosine`` over documents with a row for each integer ``id``, scored where they are read; see ``lexical_best``."""
    found = lexical_best(docs, tokens, query_terms, k)
    return topk(found.select("query_id", "id", F.round("raw", 6).alias("score")), k)


def both_topk(docs: DataFrame, tokens: Column, query_terms: DataFrame, k: int) -> DataFrame:
    """kind, query_id, id, score, rank: the rows of ``bm25_topk`` as kind 0 and of ``tfidf_topk`` as kind 1, from the same passes over the texts."""
    found = lexical_best(docs, tokens, query_terms, k, (K1, B))
    return ranked_prefix(found.select("kind", "query_id", "id", F.round("raw", 6).alias("score")), ["kind", "query_id"], [F.desc("score"), F.col("id")], k)


def topk(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    return ranked_prefix(scored, ["query_id"], [F.desc("score"), F.col(key)], k)


def min_max(scored: DataFrame, value: str = "score", out: str = "scaled") -> DataFrame:
    """Scaled within each query; a constant pool is 0.5."""
    pool = Window.partitionBy("query_id")
    low, high = F.min(value).over(pool), F.max(value).over(pool)
    return scored.withColumn(out, F.when(high - low < 1e-9, 0.5).otherwise((F.col(value) - low) / (high - low + 1e-9)))


def rrf(lists: list[DataFrame], k: int, key: str = "id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, key, rank) lists; the score is the fused one."""
    rows = lists[0].select("query_id", key, "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("query_id", key, "rank"))
    fused = rows.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return topk(fused, k, key)


#: Most vectors on the query side of one broadcast.
QUERY_BLOCK = 4096


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact inner products of every query with every vector, in blocks of queries; k best each.

    The query side's size is counted; each block of about QUERY_BLOCK is broadcast and the vectors are never shuffled: each task gives
    its k best of every query. Vectors with nulls, values that are not finite or another length meet one by one.
    """
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("width")).first()
    blocks, width = max(1, -(-sizes.n // QUERY_BLOCK)), max(1, sizes.width or 0)
    even = lambda c: F.coalesce((F.size(c) == width) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < 1e30)), F.lit(False))
    plain, asked = vectors.filter(even("embedding")), queries.filter(even("query"))
    pairs = vectors.filter(~even("embedding")).crossJoin(queries.select("query_id", "query")).select("query_id", "id", "embedding", "query")
    pairs = pairs.unionByName(plain.crossJoin(queries.filter(~even("query")).select("query_id", "query")).select("query_id", "id", "embedding", "query"))
    scored = pairs.select("query_id", "id", mathx.dot(F.col("embedding"), F.col("query")).alias("raw"))
    for i in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = vector_best(plain, own, k).select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("id").cast(vectors.schema["id"].dataType), "raw")
        scored = scored.unionByName(found)
    return topk(scored.select("query_id", "id", F.round("raw", 6).alias("score")), k)


def held_terms(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best (id, body) documents of each (query_id, words): a point for each word that the body holds, two for the first two side by side.

    Both ids are integers. Words and pairs of a block of queries are looked for in one pass over the documents, which gives the k best of each task.
    """
    found = held_best(docs, asked, k)
    return ranked_prefix(found.select("query_id", "id", F.col("raw").cast("int").alias("score")), ["query_id"], [F.desc("score"), F.col("id")], k)
