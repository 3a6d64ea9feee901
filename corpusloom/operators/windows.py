"""Word windows over paragraphs: pages to sections to windows that share paragraphs, and the choice among chunkers.

The sequential step is a fold over the word counts of a section's paragraphs, an SQL
``aggregate``; the texts are put together afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import chunking as c

# The line between pages, and the lines that begin a section.
PAGE_MARK = r"(?i)\n\s*---\s*Page\s*\d+\s*---\s*\n"
PAGE_NUMBER = r"(?i)\n\s*---\s*Page\s*(\d+)\s*---\s*\n"
SECTION_LINE = r"(?i)^\s*(abstract|introduction|background|related work|method(ology)?|experiments?|results?|discussion|conclusions?|references|\d+(\.\d+)*\s+.+)\s*$"

#: Windows of paragraph numbers, from the word counts of all. A paragraph of more than one and a half windows
#: stands for itself (its number is negative, less one) and does not touch the window that is open.
FOLD = """
aggregate(
  transform(sizes, (w, i) -> named_struct('w', w, 'i', i)),
  named_struct('done', CAST(array() AS ARRAY<ARRAY<INT>>), 'open', CAST(array() AS ARRAY<INT>), 'n', 0),
  (s, p) -> CASE
    WHEN p.w > {target} * 1.5 THEN named_struct('done', concat(s.done, array(array(-1 - p.i))), 'open', s.open, 'n', s.n)
    WHEN size(s.open) > 0 AND s.n + p.w > {target} THEN transform(
      array({kept}), k -> named_struct('done', concat(s.done, array(s.open)), 'open', concat(k.open, array(p.i)), 'n', k.n + p.w))[0]
    ELSE named_struct('done', s.done, 'open', concat(s.open, array(p.i)), 'n', s.n + p.w) END,
  s -> CASE WHEN size(s.open) > 0 THEN concat(s.done, array(s.open)) ELSE s.done END)
"""
#: The last paragraphs of a window that fit into the overlap, one at least.
KEPT = """aggregate(reverse(s.open), named_struct('open', CAST(array() AS ARRAY<INT>), 'n', 0, 'full', false),
  (k, i) -> CASE WHEN k.full OR (k.n + sizes[i] > {overlap} AND size(k.open) > 0) THEN named_struct('open', k.open, 'n', k.n, 'full', true)
            ELSE named_struct('open', concat(array(i), k.open), 'n', k.n + sizes[i], 'full', false) END)"""
NONE_KEPT = "named_struct('open', CAST(array() AS ARRAY<INT>), 'n', 0)"


def word_count(c_: Column) -> Column:
    return F.size(F.filter(F.split(c_, r"\s+"), lambda w: w != ""))


def stripped(c_: Column) -> Column:
    return F.regexp_replace(c_, r"^\s+|\s+$", "")


def pages(docs: DataFrame) -> DataFrame:
    """(id, page_no, page, text): a text cut at its page marks; what stands before the first mark is no page, and a text without marks is page 1."""
    numbers = F.regexp_extract_all("text", F.lit(PAGE_NUMBER), F.lit(1))
    cut = docs.select("id", F.split("text", PAGE_MARK).alias("parts"), numbers.alias("numbers"))
    at = cut.select("id", "numbers", F.posexplode("parts").alias("k", "text"))
    marked = F.size("numbers") > 0
    page = F.when(marked, F.get("numbers", F.col("k") - 1).cast("int")).otherwise(1)
    held = at.filter(~marked | (F.col("k") > 0)).select("id", F.col("k").alias("page_no"), page.alias("page"), stripped(F.col("text")).alias("text"))
    return held.filter("text <> ''")


def sections(paged: DataFrame) -> DataFrame:
    """(id, page_no, page, section_no, title, body) of each page, by its section lines; text before the first is in no section, and a page without any that have text is one section named ``page``."""
    lines = paged.select("id", "page_no", "page", "text", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    marked = lines.withColumn("head", F.col("line").rlike(SECTION_LINE))
    so_far = Window.partitionBy("id", "page_no").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("section_no", F.sum(F.col("head").cast("int")).over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("ln", "line")))), lambda s: s["line"]), "\n")
    found = placed.groupBy("id", "page_no", "page", "section_no").agg(F.max(F.when(F.col("head"), F.regexp_replace(stripped(F.col("line")), r"\s+", " "))).alias("title"), stripped(body).alias("body")).filter("section_no > 0 AND body <> ''")
    alone = paged.join(found.select("id", "page_no"), ["id", "page_no"], "left_anti").select("id", "page_no", "page", F.lit(0).cast("long").alias("section_no"), F.lit("page").alias("title"), F.col("text").alias("body"))
    return found.unionByName(alone)


def custom(docs: DataFrame, target: int = 900, overlap: int = 150, drop_references: bool = True) -> DataFrame:
    """(id, chunk_no, chunk_id, chunk): windows of about ``target`` words of whole paragraphs of one section of one page.

    A window begins with the last paragraphs of the one before that have ``overlap`` words together, one at least (none if there is no overlap). A paragraph of more than one and a half
    windows is cut into windows of words. Chunks are numbered from 1 through the document, and their id names page and section.
    """
    parts = sections(pages(docs))
    if drop_references:
        parts = parts.filter(F.lower(F.trim("title")) != "references")
    paras = F.filter(F.transform(F.split("body", r"\n\s*\n+"), stripped), lambda p: p != "")
    sized = parts.select("id", "page_no", "page", "section_no", "title", paras.alias("paras")).withColumn("sizes", F.transform("paras", word_count))
    kept = KEPT.format(overlap=overlap) if overlap > 0 else NONE_KEPT
    fold = FOLD.format(target=target, kept=kept)
    windows = sized.select("id", "page_no", "page", "section_no", "title", "paras", F.posexplode(F.expr(fold)).alias("k", "members"))
    own = F.filter(F.split(F.get("paras", -1 - F.col("members")[0]), r"\s+"), lambda w: w != "")
    step = max(1, target - overlap)
    cut = F.transform(F.sequence(F.lit(1), F.size(own), F.lit(step)), lambda a: F.array_join(F.slice(own, a, target), " "))
    joined = F.array(F.array_join(F.transform("members", lambda i: F.get("paras", i)), "\n\n"))
    texts = windows.select("id", "page_no", "page", "section_no", "title", "k", F.posexplode(F.when(F.col("members")[0] < 0, cut).otherwise(joined)).alias("j", "chunk"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("page_no", "section_no", "k", "j"))
    name = F.format_string("%05d|p%d|%s", "chunk_no", "page", F.trim(F.substring("title", 1, 30)))
    return texts.withColumn("chunk_no", number).select("id", "chunk_no", name.alias("chunk_id"), "chunk")


def dispatched(docs: DataFrame, best: int = 28, most: int = 40, custom_words: tuple[int, int] = (900, 150)) -> DataFrame:
    """(id, strategy, rank, chunk_no, chunk) of documents (id, text, strategy): each is cut by the chunker it names, and its best chunks by priority words are kept.

    ``custom``, ``sections``, ``sliding`` and ``pages`` are branches of their own, each of which sees its documents only; any other name is the fallback, which takes the chunks of 200 characters or more of
    pages, sections and windows in that order, equal ones once. Ties in priority go to the earlier chunk.
    """
    def of(name: str) -> DataFrame:
        return docs.filter(F.lower(F.trim("strategy")) == name)

    def by_page(rows: DataFrame) -> DataFrame:
        return pages(rows).filter(F.length("text") >= 120).select("id", F.row_number().over(Window.partitionBy("id").orderBy("page_no")).alias("chunk_no"), F.col("text").alias("chunk"))

    def by_section(rows: DataFrame) -> DataFrame:
        return c.by_heading(rows).select("id", (F.col("section") + 1).alias("chunk_no"), F.col("body").alias("chunk"))

    def by_window(rows: DataFrame) -> DataFrame:
        return c.sliding(rows, 2400, 700, 1).filter("chunk_no < 40").select("id", (F.col("chunk_no") + 1).alias("chunk_no"), "chunk")

    named = {"custom": lambda r: custom(r, *custom_words).select("id", "chunk_no", "chunk"), "sections": by_section, "sliding": by_window, "pages": by_page}
    rest = docs.filter(~F.coalesce(F.lower(F.trim("strategy")), F.lit("")).isin(*named))
    ordered = [part(rest).select("id", F.col("chunk_no").alias("pos"), F.trim("chunk").alias("chunk")).filter(F.length("chunk") >= 200) for part in (by_page, by_section, by_window)]
    fallback = c.first_chunks(list(enumerate(ordered)), most).select("id", F.col("rank").alias("chunk_no"), "chunk")
    branches = [cut(of(name)).withColumn("strategy", F.lit(name)) for name, cut in named.items()] + [fallback.withColumn("strategy", F.lit("fallback"))]
    every = reduce(DataFrame.unionByName, branches).withColumn("score", c.priority(F.col("chunk")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "chunk_no"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= min(best, most)).select("id", "strategy", "rank", "chunk_no", "chunk")
