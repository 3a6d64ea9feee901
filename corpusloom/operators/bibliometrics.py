"""Bibliometric operators over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Label rules, matched as substrings of the lower-cased record text.
SUBTOPIC_RULES = {
    "NLP Transformers": ("nlp", "language model", "machine translation", "sequence to sequence", "tokenization", "encoder decoder", "bert", "gpt", "t5", "roberta"),
    "Vision Transformers": ("vision transformer", "vit", "image classification", "segmentation", "object detection", "patch embedding", "detr", "deit", "swin"),
    "Multimodal Transformers": ("multimodal", "vision-language", "vision language", "vlm", "clip", "flamingo", "blip", "llava", "cross-modal", "text-to-image"),
    "Efficient Transformers": ("efficient transformer", "linear attention", "sparse attention", "longformer", "performer", "flashattention", "compressive", "reformer", "memory efficient", "low-rank"),
    "Fine-tuning & Adaptation": ("fine-tuning", "instruction tuning", "parameter efficient", "peft", "lora", "adapter", "prompt tuning", "alignment", "rlhf"),
    "LLM & Foundation Models": ("llm", "large language model", "foundation model", "instructgpt", "llama", "few-shot", "scaling law", "pretraining", "chatgpt"),
}
FIELD_RULES = {
    "NLP": ("nlp", "language", "translation", "question answering", "text"),
    "Computer Vision": ("image", "vision", "detection", "segmentation", "video"),
    "Multimodal AI": ("multimodal", "vision-language", "cross-modal", "audio-text"),
    "Optimization & Efficiency": ("efficient", "sparse", "latency", "throughput", "compression"),
    "LLMs": ("llm", "foundation model", "instruct", "prompt", "alignment"),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def labels(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Every label with a word in the text, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(has_any(text, words), F.lit(label)) for label, words in rules.items()]))


def subtopics(text: Column, query: str = "") -> Column:
    found = labels(text, SUBTOPIC_RULES)
    general = F.array(F.lit("General Transformers"))
    fallback = general if "transform" in query.lower() else F.when(F.contains(text, F.lit("transform")), general).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def canonical_tag(tag: Column) -> Column:
    low = F.lower(tag)
    return (F.when(F.contains(low, F.lit("transform")), "Transformers")
            .when(F.contains(low, F.lit("language")) | (low == "nlp"), "NLP")
            .when(F.contains(low, F.lit("vision")) | F.contains(low, F.lit("image")), "Computer Vision")
            .when(F.contains(low, F.lit("multimodal")), "Multimodal AI")
            .when(F.contains(low, F.lit("llm")) | F.contains(low, F.lit("foundation")), "LLMs")
            .otherwise(tag))


def top_counts(rows: DataFrame, key: str, limit: int | None, name: str = "n") -> DataFrame:
    """Counts by key, largest first and then by key."""
    counted = rows.groupBy(key).agg(F.count("*").alias(name))
    return counted.orderBy(F.desc(name), key).limit(limit) if limit else counted


def author_impact(authored: DataFrame, limit: int = 8) -> DataFrame:
    """author, paper_count, citations, impact_score from (author, citations, semantic) rows."""
    sums = authored.groupBy("author").agg(F.count("*").alias("paper_count"), F.sum(F.greatest("citations", F.lit(0))).alias("citations"), F.sum(F.greatest("semantic", F.lit(0.0))).alias("s"))
    impact = F.col("paper_count") * 3.0 + F.least(F.col("citations") / 200.0, F.lit(50.0)) + F.round("s", 6) * 5.0
    return sums.select("author", "paper_count", "citations", F.bround(impact, 2).alias("impact_score")).orderBy(F.desc("impact_score"), F.desc("citations"), "author").limit(limit)


def trend(monthly: DataFrame) -> DataFrame:
    """Compares the last two months that have records."""
    last = monthly.orderBy(F.desc("month")).limit(2).agg(F.count("*").alias("months"), F.max_by("n", "month").alias("now"), F.min_by("n", "month").alias("before"))
    status = F.when(F.col("months") < 2, "Stable").when(F.col("now") > F.col("before"), "Rising").when(F.col("now") < F.col("before"), "Declining").otherwise("Stable")
    return last.select(status.alias("trend"), F.col("now").alias("last_count"), F.col("before").alias("previous_count"))


def field_rows(works: DataFrame, text: str, tag: str, query: str = "") -> DataFrame:
    """One row per label that a record adds: rules, canonical tags, and the query's field where no rule matched."""
    matched = labels(F.col(text), FIELD_RULES)
    tags = F.when(F.trim(tag) != "", F.array(canonical_tag(F.trim(tag)))).otherwise(F.array().cast("array<string>"))
    extra = F.when((F.size(matched) == 0) & F.lit("transform" in query.lower()), F.array(F.lit("Transformers"))).otherwise(F.array().cast("array<string>"))
    return works.select("id", F.explode(F.concat(matched, tags, extra)).alias("label"))


def ranked_prefix(rows: DataFrame, partition: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first rows of each partition, numbered; the engine limits them before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(name) <= most)
