"""A training-data pipeline over ``documents``: five stages, each of them one operator.

toxicity (documents scored 0.5 or more go), n-gram Jaccard join (one document of each
group stays), benchmark decontamination (documents with a benchmark window go), secret
scans (reported spans are masked), best-fit packing (the documents become sequences).
Each stage works on what its predecessor wrote; all but the last return the columns of
``documents``. An empty table passes through every stage; null texts are kept until
packing, where they are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, jaccard, packing, secrets, toxicity
from corpusloom.llm.shared import load, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows among docs; keeps the columns and the clean documents."""
    model = toxicity.train(toxicity.labelled_rows(docs, load(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard.deduplicated(docs, size=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported span; n_chars follows the text."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.pack(packing.pieces(docs), label="pipeline-pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: Scoring, similarity groups and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
