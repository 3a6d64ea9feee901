"""Chunking as table expressions; the sequential chunkers run over one document's arrays at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import SECTION_HEADINGS

# Words that make a chunk worth reading first.
PRIORITY = ("method", "architecture", "model", "transformer", "attention", "experiment", "results", "evaluation", "dataset", "benchmark", "training", "loss", "approach", "encoder", "decoder",
            "proposed", "compared", "achieves", "outperforms", "baseline", "metric", "accuracy", "f1", "bleu", "ablation", "limitation", "hyperparameter", "contribution")


def paragraphs(text: Column, min_chars: int = 160) -> Column:
    """Paragraphs of min_chars or more; the whole text if there is none."""
    long = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda p: F.length(p) >= min_chars)
    return F.when(F.size(long) > 0, long).when(F.trim(text) != "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))


def sliding(docs: DataFrame, size: int = 1200, step: int = 900, least: int = 200) -> DataFrame:
    """(id, chunk_no, start, chunk) windows of characters; windows under ``least`` are dropped, then chunks are numbered."""
    starts = docs.select("id", "text", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))).alias("chunk_no", "start"))
    return starts.select("id", "chunk_no", "start", F.substr("text", F.col("start") + 1, F.lit(size)).alias("chunk")).filter(F.length("chunk") >= least)


def by_words(docs: DataFrame, size: int = 150, overlap: int = 30) -> DataFrame:
    """(id, chunk_no, chunk) windows of words."""
    words = docs.select("id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words")).filter(F.size("words") > 0)
    at = words.select("id", "words", F.posexplode(F.sequence(F.lit(1), F.size("words"), F.lit(size - overlap))).alias("chunk_no", "start"))
    return at.select("id", "chunk_no", F.array_join(F.slice("words", F.col("start"), size), " ").alias("chunk"))


def priority(text: Column) -> Column:
    low = F.lower(text)
    out = F.contains(text, F.lit("##")).cast("int")
    for word in PRIORITY:
        out = out + F.contains(low, F.lit(word)).cast("int")
    return out


def content_kind(text: Column) -> Column:
    low = F.lower(text)
    any_of = lambda words: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
    return (F.when(any_of(("method", "approach", "algorithm", "procedure")), "methodology").when(any_of(("result", "experiment", "evaluation", "performance")), "results")
            .when(any_of(("introduction", "background", "motivation")), "introduction").when(any_of(("conclusion", "summary", "future work")), "conclusion").otherwise("general"))


def fold_chunks(paras: list[str], most: int, split_at: int, alike) -> list[str]:
    """Greedy fold: a new chunk begins when the text would pass ``most``, or ``split_at`` at a change of subject."""
    out: list[list[str]] = []
    size = 0
    for p in paras:
        grown = size + len(p) + 2
        if out and out[-1] and (grown > most or (grown > split_at and not alike(out[-1], p))):
            out.append([])
            size = 0
        if not out:
            out.append([])
        out[-1].append(p)
        size += len(p) + 2
    return ["\n\n".join(c) for c in out if c]


def boundary_chunks(text: str, size: int = 8000, overlap: int = 500, cap: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, text): cut at a paragraph, else at a sentence, in the second half of the window; stops at the end."""
    out: list[tuple[int, int, str]] = []
    start = 0
    while start < len(text) and (cap is None or len(out) < cap):
        end = min(len(text), start + size)
        if end < len(text):
            middle = start + size // 2
            at = text.rfind("\n\n", middle, end)
            if at < 0:
                at = max(text.rfind(m, middle, end) for m in (". ", "! ", "? "))
                at = at + 1 if at >= 0 else -1
            if at > start:
                end = at
        part = text[start:end].strip()
        if part:
            out.append((start, end, part))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def _per_document(docs: DataFrame, cut) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, chunks = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, c in enumerate(cut(t or "")):
                    ids.append(i)
                    numbers.append(k)
                    chunks.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], names=["id", "chunk_no", "chunk"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, chunk_no int, chunk string")


def semantic(docs: DataFrame, most: int = 3400, split_at: int = 2600, least_alike: float = 0.78) -> DataFrame:
    """(id, chunk_no, chunk): paragraphs folded while they fit and their hashed embeddings stay close."""

    def alike(chunk: list[str], para: str) -> bool:
        from corpusloom.functions.udfs import hash_embedding

        centre = [sum(x) / len(chunk) for x in zip(*(hash_embedding(p) for p in chunk), strict=True)]
        other = hash_embedding(para)
        size = (sum(x * x for x in centre) ** 0.5) * (sum(x * x for x in other) ** 0.5)
        return size > 0 and sum(a * b for a, b in zip(centre, other, strict=True)) / size >= least_alike

    def cut(text: str) -> list[str]:
        paras = [p.strip() for p in text.split("\n\n") if len(p.strip()) >= 160] or ([text.strip()] if text.strip() else [])
        return fold_chunks(paras, most, split_at, alike)

    return _per_document(docs, cut)


def by_boundary(docs: DataFrame, size: int = 8000, overlap: int = 500, cap: int | None = None) -> DataFrame:
    return _per_document(docs, lambda t: [c for _, _, c in boundary_chunks(t, size, overlap, cap)])


def by_heading(docs: DataFrame) -> DataFrame:
    """(id, section, heading, body): the lines from each heading to the next; text before the first is section 0. Sections without text are left out.

    A heading is one of the known section names, or a line of 60 characters at most that ends without a mark.
    """
    known = "(?i)^(" + "|".join(h.replace(" ", r"\s+") for h in SECTION_HEADINGS) + ")$"
    line = F.trim("line")
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    marked = lines.withColumn("head", line.rlike(known) | (F.length(line).between(1, 60) & ~line.rlike("[.!?:;,]$")))
    so_far = Window.partitionBy("id").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("section", F.sum(F.col("head").cast("int")).over(so_far).cast("int"))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("ln", "line"))))
    grouped = numbered.groupBy("id", "section").agg(F.max(F.when(F.col("head"), line)).alias("heading"), F.array_join(F.transform(body, lambda s: s["line"]), "\n").alias("body"))
    return grouped.withColumn("body", F.trim("body")).filter("body <> ''")


def with_tail(chunks: DataFrame, words: int) -> DataFrame:
    """(id, chunk_no, chunk) with the last words of the chunk before in front."""
    before = F.lag("chunk").over(Window.partitionBy("id").orderBy("chunk_no"))
    tail = F.array_join(F.slice(F.reverse(F.split(before, " ")), 1, words), " ")
    held = F.array_join(F.reverse(F.split(tail, " ")), " ")
    return chunks.select("id", "chunk_no", F.when(before.isNull(), F.col("chunk")).otherwise(F.concat(held, F.lit("\n\n"), F.col("chunk"))).alias("chunk"))


def context_of(lines: Column, at: Column, around: int) -> Column:
    """The line at a place (from 1) and the lines around it, joined."""
    low = F.greatest(at - around, F.lit(1))
    return F.array_join(F.slice(lines, low, at + around - low + 1), " ")


def embedding_text(kind: Column, number: Column, body: Column, context: Column) -> Column:
    """What is embedded of an element, by kind."""
    named = F.concat(F.initcap(kind), F.lit(" "), number.cast("string"), F.lit("\nContext: "), F.substring(context, 1, 300))
    return F.when(kind == "text", F.concat(F.lit("Text\n"), F.substring(body, 1, 480))).otherwise(named)


def elements(docs: DataFrame, least: int = 100, around: int = 2) -> DataFrame:
    """(id, kind, number, chunk_id, context, embedding_text): each text's table, by its first line with a bar, and the text itself if it has ``least`` characters."""
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("|"))), True).cast("int")
    tables = docs.withColumn("at", at).filter("at > 0").select("id", F.lit("table").alias("kind"), F.lit(1).alias("number"), F.col("text").alias("body"), context_of(lines, F.col("at"), around).alias("context"))
    texts = docs.filter(F.length(F.trim("text")) >= least).select("id", F.lit("text").alias("kind"), F.lit(0).alias("number"), F.col("text").alias("body"), F.substring("text", 1, 500).alias("context"))
    every = tables.unionByName(texts)
    key = F.substring(F.md5(F.concat_ws("_", "id", "kind", "number")), 1, 16)
    return every.select("id", "kind", "number", key.alias("chunk_id"), "context", embedding_text(F.col("kind"), F.col("number"), F.col("body"), F.col("context")).alias("embedding_text"))


def first_chunks(parts: list[tuple[int, DataFrame]], most: int) -> DataFrame:
    """(id, rank, strategy, chunk): chunks of several strategies in order, equal texts of a document once, ``most`` a document."""
    every = None
    for number, part in parts:
        own = part.select("id", F.struct(F.lit(number).alias("strategy"), F.col("pos").alias("pos")).alias("at"), "chunk")
        every = own if every is None else every.unionByName(own)
    once = every.groupBy("id", "chunk").agg(F.min("at").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("at"))).filter(F.col("rank") <= most).select("id", "rank", "at.strategy", "chunk")
