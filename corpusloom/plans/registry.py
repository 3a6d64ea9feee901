"""Collects the query modules under one name-to-callable map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import analytics, answers, assembly, documents, extraction, graphs, layout, levels, questions, records, relational, relevance, reviews, search, streams, views, windows

MODULES = [analytics, search, records, graphs, documents, relational, relevance, streams, answers, questions, reviews, views, assembly, layout, levels, windows, extraction]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


#: Columns whose SQL type would differ from the query's: counts that are int here, decimals that are double.
TYPES = {
    "source_cap": {"place": "INTEGER"},
    "min_keep_backfill": {"size": "INTEGER"},
    "bm25_topk": {"rank": "INTEGER"},
    "tfidf_cosine_topk": {"rank": "INTEGER"},
    "rrf_fuse": {"rank": "INTEGER"},
    "multi_query_rrf": {"rank": "INTEGER"},
    "hybrid_blend": {"rank": "INTEGER"},
    "vector_topk": {"rank": "INTEGER"},
    "anchor_strength": {"prefix_strength": "DOUBLE", "inner_strength": "DOUBLE"},
    "intent_router": {"confidence": "DOUBLE"},
    "stage1_variants": {"rank": "INTEGER"},
    "scores": {"confidence": "DOUBLE"},
    "dedup_merge": {"abstract_size": "INTEGER"},
    "jaccard_bigram_rerank": {"rank": "INTEGER"},
    "sliding_chunks": {"size": "INTEGER"},
    "word_chunks": {"chunk_no": "INTEGER"},
    "chunk_rank": {"rank": "INTEGER", "chunk_no": "INTEGER"},
    "keywords_per_chunk": {"rank": "INTEGER"},
    "table_structure": {"n_rows": "INTEGER", "n_cols": "INTEGER"},
    "number_grounding": {"n_unsupported": "INTEGER", "confidence": "DOUBLE"},
    "evidence_top": {"rank": "INTEGER", "score": "INTEGER"},
    "section_merge": {"score": "DOUBLE"},
    "context_window_turns": {"back": "INTEGER"},
    "topic_relevance": {"topic": "DOUBLE", "concept": "DOUBLE"},
    "validate_response": {"confidence": "DOUBLE"},
    "lexical_search": {"rank": "INTEGER"},
    "page_fallback": {"score": "INTEGER", "rank": "INTEGER"},
}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= module.ORACLES
    for name, columns in TYPES.items():
        casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in columns.items())
        out[name] = f"SELECT * REPLACE ({casts}) FROM ({out[name]})"
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["multi_query_rrf"](spark, sf_dir)
