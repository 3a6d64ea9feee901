"""Views of ranked records: author facet, composite fallback, sort modes, cleaned counts and cursor pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_author(written: DataFrame, name: str, query: str) -> DataFrame:
    """ids of the (id, author) rows whose author holds the text, in any case; it is no pattern."""
    return written.filter(F.contains(F.lower(name), F.lit(query.strip().lower()))).select("id").distinct()


def surnames(names: Column, most: int = 4) -> Column:
    """Distinct last words, in lower case, of the first ``most`` names."""
    last = F.transform(F.slice(names, 1, most), lambda n: F.element_at(F.split(F.lower(F.trim(n)), r"\s+"), -1))
    return F.array_distinct(F.filter(last, lambda w: w != ""))


def composite(score: Column, *others: Column) -> Column:
    """The composite, or the greatest of the other scores where there is none."""
    return F.coalesce(score, F.greatest(*[F.coalesce(o, F.lit(0.0)) for o in others]))


def sorted_views(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each key in three orders; ties go to the composite in the order's own direction, then to id."""
    orders = {"citations": [F.desc("citations"), F.desc("final"), F.col("id")], "newest": [F.desc("published_date"), F.desc("final"), F.col("id")], "oldest": [F.col("published_date"), F.col("final"), F.col("id")]}
    out = None
    for mode, order in orders.items():
        view = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most).withColumn("mode", F.lit(mode))
        out = view if out is None else out.unionByName(view)
    return out


def clean_counts(counts: DataFrame, most: int) -> DataFrame:
    """(name, n, rank) by count, then name; blank names and counts below 0 are left out. The ``most`` first are taken before they are ranked in one place."""
    first = counts.filter((F.trim("name") != "") & (F.col("n") >= 0)).orderBy(F.desc("n"), F.lower("name"), "name").limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.lower("name"), "name"))).select("name", "n", "rank")


def cursor_pages(rows: DataFrame, keys: list[str], cursor: str, per_page: int, most_rows: int, most_pages: int) -> DataFrame:
    """(keys, page, n, next_cursor): pages of a cursor scan, which ends at most_rows, at most_pages or at a short page (its next_cursor is null)."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(cursor))).filter(F.col("__n") <= min(most_rows, per_page * most_pages))
    pages = numbered.groupBy(*keys, F.floor((F.col("__n") - 1) / per_page).cast("int").alias("page")).agg(F.count("*").alias("n"), F.max(cursor).alias("__last"))
    return pages.select(*keys, "page", "n", F.when(F.col("n") == per_page, F.col("__last")).alias("next_cursor"))
