"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, compaction, decontaminate, fingerprints, jaccard, langid, packing, runs, secrets, substrings, toxicity, urlfilter, warc
from corpusloom.llm.shared import load


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(load(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(load(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    profiles = langid.learn(docs.filter(~langid.held_out()))
    return langid.identify(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    judged = urlfilter.evaluate(urlfilter.dated_captures(pages), urlfilter.derived_entries(pages))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return judged.select("page_id", "url", stamp("fetched_at"), "host", "list_domain", stamp("valid_from"), "blocked")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("item_ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(load(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(load(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return fingerprints.edited_fingerprints(docs, fingerprints.rarity_table(docs))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(load(spark, sf_dir, "documents"), size=4, threshold=85)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.labelled_rows(docs, load(spark, sf_dir, "labels")))
    return toxicity.scored(docs, model).select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted")


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted(load(spark, sf_dir, "clicks"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.decode(bpe.encode(load(spark, sf_dir, "documents")))
    n_tokens = F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens")
    return back.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


#: The text of every tenth document, by its doc_id, becomes periodic from some word on.
PERIODIC = """
transform(array(filter(split(coalesce(text, ''), '[\\\\x09-\\\\x0D\\\\x20]+'), w -> w <> '')), ws -> array_join(transform(ws, (w, i) ->
  CASE WHEN i < g % size(ws) THEN w
  ELSE ws[CAST(g % size(ws) + (i - g % size(ws)) % (1 + (size(ws) - g % size(ws)) DIV (3 + g % 8)) AS INT)] END), ' '))[0]
"""


def made_periodic(docs: DataFrame) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    numbered = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    return numbered.select("doc_id", F.when(F.col("chosen"), F.expr(PERIODIC)).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(made_periodic(load(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.short")
    exponent = F.expr("1000 * best.length DIV -best.short").alias("exponent_milli")
    return found.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), exponent, "runs_sha256", "collapsed_sha256")


QUERIES = {"op1_substrings": op1_substrings, "op2_warc": op2_warc, "op3_langid": op3_langid, "op4_urlfilter": op4_urlfilter, "op5_decontaminate": op5_decontaminate, "op6_packing": op6_packing, "op7_secrets": op7_secrets, "op8_fingerprints": op8_fingerprints, "op9_jaccard": op9_jaccard, "op10_toxicity": op10_toxicity, "op11_compaction": op11_compaction, "op12_bpe": op12_bpe, "op13_runs": op13_runs}

ORACLES: dict[str, str] = {"op4_urlfilter": urlfilter.ORACLE}
