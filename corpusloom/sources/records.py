"""Provider records to the record model, caches and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text


def inverted_text(index: Column) -> Column:
    """An inverted index (word to places) as text in order."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def normalized(items: DataFrame) -> DataFrame:
    """id, title, abstract, published_date, tags, url of provider items; untitled ones go.

    Items have id, title, year, landing, doi, concepts and an inverted index; the first
    eight concepts stay, and the address is the landing page, else the DOI, else the id.
    """
    doi = text.normalize_doi("doi")
    return items.filter(text.blank_to_null("title").isNotNull()).select(
        text.openalex_id("id").alias("id"), F.trim("title").alias("title"), inverted_text(F.col("index")).alias("abstract"),
        F.when(F.col("year").isNotNull(), F.concat(F.col("year").cast("string"), F.lit("-01-01"))).alias("published_date"),
        F.slice("concepts", 1, 8).alias("tags"), F.coalesce(text.blank_to_null("landing"), F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)), F.col("id")).alias("url"))


def cache_live(entries: DataFrame, now: str, ttl_seconds: int, keep: int) -> DataFrame:
    """Entries within their time, the newest of each key, the last ``keep`` of them."""
    live = entries.filter(F.col("ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    newest = live.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq")))).filter("n = 1").drop("n")
    return newest.orderBy(F.desc("ts"), F.desc("seq")).limit(keep)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges as two Parquet folders."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
