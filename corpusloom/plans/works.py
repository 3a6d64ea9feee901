"""Adapters that bind the driver's tables to the bibliographic record model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import load

#: DuckDB twin of works_star; prefix each oracle with ``WITH``.
WORKS_SQL = """
line AS (SELECT l_partkey, count(*) AS citations, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_partkey),
auth AS (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
works AS (
  SELECT p_partkey AS id, concat(p_name, ' ', p_type) AS title, coalesce(citations, 0) AS citations,
         strftime(first_ship, '%Y-%m-%d') AS published_date, p_brand AS venue, p_name, p_type,
         CASE p_partkey % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'openalex' ELSE 'arxiv,openalex' END AS source,
         p_size, p_retailprice
  FROM part LEFT JOIN line ON p_partkey = l_partkey)
"""


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, author): the distinct suppliers of each part."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    names = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return lines.join(names, lines.l_suppkey == names.s_suppkey).select(
        F.col("l_partkey").alias("id"), F.col("s_name").alias("author")).distinct()


def works_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliographic record per part."""
    line = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("citations"), F.min("l_shipdate").alias("first_ship"))
    part = load(spark, sf_dir, "part")
    return part.join(line, part.p_partkey == line.l_partkey, "left").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.coalesce("citations", F.lit(0)).alias("citations"),
        F.date_format("first_ship", "yyyy-MM-dd").alias("published_date"),
        F.col("p_brand").alias("venue"), "p_name", "p_type",
        F.when(F.col("p_partkey") % 3 == 0, "arxiv").when(F.col("p_partkey") % 3 == 1, "openalex")
        .otherwise("arxiv,openalex").alias("source"), "p_size", "p_retailprice")

#: DuckDB twin of works_docs.
DOCS_SQL = """
docs AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, lang AS tag, source,
         strftime(DATE '2015-01-01' + CAST(doc_id * 7 % 3650 AS INT), '%Y-%m-%d') AS published_date, n_chars AS citations,
         lower(concat(split_part(text, chr(10), 1), ' ', text, ' ', lang)) AS body
  FROM documents)
"""


def works_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliographic record per document; the tables hold no dates, so doc_id gives one."""
    docs = load(spark, sf_dir, "documents")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("tag"), "source",
        F.date_format(F.expr("date_add(date '2015-01-01', cast(doc_id * 7 % 3650 as int))"), "yyyy-MM-dd").alias("published_date"),
        F.col("n_chars").alias("citations"), F.lower(F.concat(title, F.lit(" "), "text", F.lit(" "), "lang")).alias("body"))
