"""Texts put together from parts, and parts told apart: fused answers, source unions, markdown lines and canonical sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Question types whose answers are fused, section words with the field they belong to (the first that is found decides), and what keeps a line from being one of authors.
FUSED = ("comparison", "difference", "relation", "synthesis")
SECTIONS = (("abstract", "abstract"), ("introduction", "introduction"), ("related work", "introduction"), ("background", "introduction"), ("method", "methodology"), ("methodology", "methodology"), ("approach", "methodology"), ("model", "methodology"),
            ("experiment", "results"), ("result", "results"), ("evaluation", "results"), ("discussion", "results"), ("conclusion", "conclusion"), ("concluding", "conclusion"), ("limitation", "limitations"), ("future", "future_work"))
NO_AUTHORS = ("abstract", "doi", "http", "arxiv")


def fused(parts: Column, method: str, query: Column | None = None) -> Column:
    """One text of (answer, kind) parts in order: with a header each, as the context of a question, or retrieved ones before analyses."""
    if method == "synthesis":
        context = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("**Context "), (i + 1).cast("string"), F.lit(":** "), p["answer"])), "\n\n")
        return F.concat(F.lit('\nBased on the following context pieces, provide a comprehensive answer to the question: "'), query, F.lit('"\n\n'), context, F.lit("\n\n**Synthesized Answer:**\n"))
    if method == "weighted":
        of = lambda keep: F.transform(F.filter(parts, keep), lambda p: p["answer"])
        found, analyses = of(lambda p: p["kind"] != "synthesis"), of(lambda p: p["kind"] == "synthesis")
        texts = F.array(F.when(F.size(found) > 0, F.concat(F.lit("**Retrieved Information:**\n"), F.array_join(found, "\n\n"))), F.when(F.size(analyses) > 0, F.concat(F.lit("**Analysis:**\n"), F.array_join(analyses, "\n\n"))))
        return F.array_join(F.array_compact(texts), "\n\n")
    headed = F.transform(parts, lambda p, i: F.when(p["kind"] == "synthesis", p["answer"]).otherwise(F.concat(F.lit("**Part "), (i + 1).cast("string"), F.lit(" ("), p["kind"], F.lit("):**\n"), p["answer"])))
    return F.array_join(headed, "\n\n")


def source_union(sources: list[tuple[str, DataFrame]], most: int) -> DataFrame:
    """(key, combined, n_sources): the (key, text, url) rows of each source, cut, one after the other under its name and address; blank ones are left out."""
    every = None
    for place, (name, rows) in enumerate(sources):
        own = rows.filter(F.trim("text") != "").select("key", F.lit(place).alias("place"), F.concat(F.lit(f"[{name}]"), F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit(" — "), "url")).otherwise(""), F.lit("\n"), F.substring("text", 1, most)).alias("part"))
        every = own if every is None else every.unionByName(own)
    grouped = every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    return grouped.select("key", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("combined"), F.size("parts").alias("n_sources"))


def line_kind(line: Column) -> Column:
    t = F.trim(line)
    return F.when(t == "", "blank").when(F.startswith(t, F.lit("## ")), "heading").when(F.startswith(t, F.lit("- ")) | F.startswith(t, F.lit("* ")), "bullet").otherwise("body")


def line_text(line: Column) -> Column:
    """The line without its mark, bold and inline formulas as HTML."""
    bare = F.regexp_replace(F.trim(line), r"^(## |- |\* )", "")
    safe = F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(F.regexp_replace(safe, r"\$([^$\n]+)\$", "<code>$1</code>"), r"\*\*(.+?)\*\*", "<b>$1</b>")


def canonical_section(heading: Column) -> Column:
    """The field that a heading's words belong to, null for none."""
    low = F.lower(F.trim(heading))
    return reduce(lambda out, rule: F.when(F.contains(low, F.lit(rule[0])), rule[1]).otherwise(out), reversed(SECTIONS), F.lit(None).cast("string"))


def author_line(lines: Column) -> Column:
    """The first of the first ten lines with a comma that can be a list of names."""
    def fits(x: Column) -> Column:
        low = F.lower(x)
        refused = F.startswith(x, F.lit("#"))
        for w in NO_AUTHORS:
            refused = refused | F.contains(low, F.lit(w))
        return F.contains(x, F.lit(",")) & (F.length(x) < 300) & ~refused

    return F.coalesce(F.get(F.filter(F.slice(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), 1, 10), fits), F.lit(0)), F.lit(""))
