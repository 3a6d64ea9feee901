"""Answer validation and evidence mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.bibliometrics import has_any

# Signal groups and the negations that cancel them within a sentence.
REPRO_SIGNALS = {
    "hyperparameters": ("learning rate", "batch size", "epoch", "optimizer", "seed", "weight decay", "dropout", "warmup"),
    "setup": ("implementation details", "training setup", "training procedure", "quantization scheme", "hardware setup", "training configuration", "number of layers", "hidden size", "attention heads"),
    "data": ("dataset", "benchmark", "train split", "validation split", "test split", "training set", "dev set", "held-out"),
    "protocol": ("metric", "ablation study", "evaluation protocol", "baseline comparison", "protocol"),
    "release": ("code", "checkpoint", "github", "repository", "release", "open-source"),
}
FAIRNESS_SIGNALS = {
    "baselines": ("baseline", "baselines", "vs.", "compared to", "against"),
    "tasks_or_datasets": ("dataset", "benchmark", "test set", "evaluation set"),
    "metrics": ("accuracy", "f1", "bleu", "rouge", "auc", "map", "perplexity", "exact match"),
    "controls": ("same setting", "same budget", "matched", "controlled", "same training", "tuned"),
    "caveats": ("limitation", "caveat", "not directly comparable", "different setting"),
}
NEGATION = (r"\b(does not|do not|not mention|not provide|not release|not report|not specify|not explicit|no code|no checkpoint|omit|without|absent|missing|lack|not available|not included|unreported)\b")
SPECIFIC = (r"(?i)\b(dataset|benchmark|baseline|ablation|accuracy|f1[- ]score|bleu|rouge|perplexity|auc|exact match|memory footprint|latency|throughput|learning rate|batch size|epoch|optimizer|checkpoint|"
            r"github|open-source|train split|test split|validation split|held-out|evaluation protocol|does not report|does not mention|no code|no checkpoint|not release|not evaluat|limited to|only evaluates|only compares)\b")
GENERIC_OPENERS = ("the paper", "this paper", "the study", "the research", "the authors", "in this", "this work")
# Names that tie a denial to a metric.
DATASET_WORDS = ("glue", "squad", "mnli", "qqp", "sst", "wikitext", "wmt", "iwslt", "bleu", "rouge", "accuracy", "f1", "auc", "map")
DENIALS = ("not evaluated", "not tested", "has not been evaluated", "has not been tested")
SECTION_PRIORITY = {"results": 0, "abstract": 1, "conclusion": 2, "methodology": 3, "introduction": 4}


def occurrences(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def evidence_score(sentence: Column, keywords: tuple[str, ...]) -> Column:
    """4 a digit, 3 a keyword, 2 for a percent sign, 2 for a limitation, 1 for 40 characters."""
    low = F.lower(sentence)
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.contains(low, F.lit(k)).cast("int")
    return (occurrences(sentence, "[0-9]") * 4 + hits * 3 + F.contains(sentence, F.lit("%")).cast("int") * 2
            + has_any(low, ("not ", "only ", "missing", "limited", "unclear")).cast("int") * 2 + (F.length(sentence) > 40).cast("int"))


def sentence_rows(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """(key, pos, sentence): lines, then sentences, in order."""
    lines = rows.select(key, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    parts = lines.select(key, "line_no", F.posexplode(text.sentences(text.collapse_space("line"))).alias("part_no", "sentence"))
    return parts.select(key, (F.col("line_no") * 100_000 + F.col("part_no")).alias("pos"), "sentence")


def best_evidence(sentences: DataFrame, key: str, keywords: tuple[str, ...], most: int) -> DataFrame:
    """The best distinct sentences of a paper, cut to 160 characters."""
    scored = sentences.withColumn("score", evidence_score(F.col("sentence"), keywords))
    once = scored.groupBy(key, F.lower("sentence").alias("low")).agg(F.max("score").alias("score"), F.min("pos").alias("pos"), F.min_by("sentence", "pos").alias("sentence"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos")))
    return ranked.filter(F.col("rank") <= most).select(key, "rank", "score", F.substring("sentence", 1, 160).alias("sentence"))


def signal_groups(sentences: DataFrame, key: str, signals: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, grp): groups named in a sentence without a negation."""
    low = F.lower("sentence")
    found = F.array_compact(F.array(*[F.when(has_any(low, words), F.lit(name)) for name, words in signals.items()]))
    return sentences.filter(~low.rlike(NEGATION)).select(key, F.explode(found).alias("grp")).distinct()


def field_score(c: Column) -> Column:
    """Length, digits, percent and plus-minus signs; less for generic openings."""
    low = F.lower(F.trim(c))
    generic = F.lit(False)
    for opener in GENERIC_OPENERS:
        generic = generic | F.startswith(low, F.lit(opener))
    value = F.length(c) * 0.5 + occurrences(c, r"[0-9]+") * 8 + occurrences(c, "%") * 15 + occurrences(c, "±") * 10 - F.when(generic, 20).otherwise(0)
    return F.when(low.isin("", "not found") | c.isNull(), 0.0).otherwise(value)


def quality(response: Column, query: Column) -> dict[str, Column]:
    """Completeness, relevance, clarity, conciseness and their mean."""
    words = F.filter(F.split(response, r"\s+"), lambda w: w != "")
    q, r = F.array_distinct(text.tokens_space(query)), F.array_distinct(text.tokens_space(response))
    complete = F.when(F.length(F.trim(response)) > 100, F.least(F.lit(1.0), F.length(response) / 500)).otherwise(0.0)
    relevant = F.least(F.lit(1.0), F.size(F.array_intersect(q, r)) / F.greatest(F.size(q), F.lit(1)))
    clear = 1.0 / (1 + F.size(words) / F.greatest(F.size(F.split(response, "[.!?]+")), F.lit(1)) / 20)
    brief = F.when(F.length(response) > 1000, F.greatest(F.lit(0.5), 1.0 - (F.length(response) - 1000) / 2000)).otherwise(1.0)
    parts = {"completeness": complete, "relevance": relevant, "clarity": clear, "conciseness": brief}
    return {k: F.round(v, 6) for k, v in parts.items()} | {"overall": F.round((complete + relevant + clear + brief) / 4, 6)}


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def without_contradictions(items: DataFrame, key: str) -> DataFrame:
    """(key, pos, item) rows without the denials of testing that a metric of the same paper contradicts: both name one dataset or metric word, or the denial is of text classification and a metric of a task in it."""
    low = F.lower("item")
    metric = low.rlike(r"\b\d[\d.]*\s*(%|f1|accuracy|bleu|rouge|auc|map)(?!\w)") | (low.rlike("[0-9]") & has_any(low, DATASET_WORDS))
    marked = items.withColumn("denied", has_any(low, DENIALS)).withColumn("words", F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in DATASET_WORDS]), lambda w: w.isNotNull())).withColumn("metric", metric)
    known = marked.filter("metric").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("known"))
    classes = F.array(*[F.lit(w) for w in ("glue", "mnli", "qqp", "sst")])
    joined = marked.join(known, key, "left")
    against = F.arrays_overlap("words", "known") | (F.contains(low, F.lit("text classification")) & F.arrays_overlap(F.col("known"), classes))
    return joined.filter(~(F.col("denied") & F.coalesce(against, F.lit(False)))).select(*items.columns)


def compressed(sentences: DataFrame, key: str, most: int) -> DataFrame:
    """(key, evidence): the first specific sentence, else the first, cut at a word if it is longer than ``most``."""
    order = F.struct((~F.col("sentence").rlike(SPECIFIC)).alias("plain"), "pos")
    best = sentences.groupBy(key).agg(F.min_by("sentence", order).alias("s"))
    cut = F.concat(F.regexp_replace(F.substring("s", 1, most - 3), " [^ ]*$", ""), F.lit("…"))
    return best.select(key, F.when(F.length("s") > most, cut).otherwise(F.col("s")).alias("evidence"))
