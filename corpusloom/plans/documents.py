"""Chunking, validation, evidence, conversation and cache queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import bibliometrics as b
from corpusloom.operators import chunking as c
from corpusloom.operators import evidence as e
from corpusloom.operators import graphs as g
from corpusloom.plans.analytics import any_sql
from corpusloom.sources.tables import load, load_events

KEYS = ("the", "und", "que", "token")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.sliding(docs(spark, sf_dir)).select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("size"))


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.by_words(docs(spark, sf_dir)).select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"), text.chunk_key(F.col("id"), F.lit("text"), F.col("chunk_no")).alias("chunk_id"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return lines.select("id", F.posexplode(c.paragraphs(F.col("text"))).alias("pos", "p")).select("id", "pos", F.md5("p").alias("p_md5"))


def chunk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by priority words, the 28 best of each source."""
    chunks = c.by_words(docs(spark, sf_dir)).join(docs(spark, sf_dir).select("id", "source"), "id")
    ranked = b.ranked_prefix(chunks.withColumn("score", c.priority(F.col("chunk"))), ["source"], [F.desc("score"), F.col("id"), F.col("chunk_no")], 28)
    return ranked.select("source", "rank", "id", "chunk_no", "score")


def keywords_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent words of four letters or more in every text."""
    words = docs(spark, sf_dir).select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_]{4,}"), F.lit(0))).alias("word"))
    return b.ranked_prefix(words.groupBy("id", "word").agg(F.count("*").alias("n")), ["id"], [F.desc("n"), F.col("word")], 5)


def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(c.content_kind(F.col("text")).alias("kind"), "lang").groupBy("kind", "lang").agg(F.count("*").alias("n"))


def table_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and first header of texts with cell bars; a separator line counts as a row."""
    rows = docs(spark, sf_dir).filter(F.contains("text", F.lit("|"))).select("id", F.split(F.trim("text"), "\n").alias("lines"))
    cells = F.filter(F.transform(F.split(F.col("lines")[0], r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    bars = F.filter("lines", lambda x: F.contains(x, F.lit("|")) & ~F.startswith(F.trim(x), F.lit("|-")))
    return rows.select("id", F.size(bars).alias("n_rows"), F.size(cells).alias("n_cols"), F.get(cells, F.lit(0)).alias("first_header"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the question before them."""
    rows = load(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    paired = rows.withColumn("question", F.lag("text").over(before)).withColumn("asked", F.lag("role").over(before))
    return paired.filter("role = 'assistant' and asked = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


TURNS_SQL = """p AS (SELECT *, lag(text) OVER w AS question, lag(role) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id, turn, question, text AS answer FROM p WHERE role = 'assistant' AND asked = 'user')"""


def response_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", *[v.alias(k) for k, v in e.quality(F.col("answer"), F.col("question")).items()])


def number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an answer that its question does not hold, and the confidence left."""
    lone = F.array_except(e.numbers(F.col("answer")), e.numbers(F.col("question")))
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(lone).alias("n_unsupported"), F.array_join(F.array_sort(lone), ",").alias("unsupported"), F.when(F.size(lone) > 0, 0.7).otherwise(1.0).alias("confidence"))


def nearest_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to part sizes that a brand does not have, and the nearest it has (the smaller of two)."""
    part = load(spark, sf_dir, "part")
    known = part.filter("p_size % 3 = 0").select("p_brand", F.col("p_size").alias("have")).distinct()
    refs = part.filter("p_size % 3 <> 0").select("p_brand", F.col("p_size").alias("ref")).distinct()
    best = refs.join(known, "p_brand").groupBy("p_brand", "ref").agg(F.min(F.struct(F.abs(F.col("have") - F.col("ref")).alias("d"), "have")).alias("best"))
    return best.select("p_brand", "ref", F.col("best.have").alias("nearest"))


def unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a text that its source has no document for: an anti-join of exploded references."""
    rows = docs(spark, sf_dir)
    refs = rows.select("id", "source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}"), F.lit(0)))).alias("n"))
    have = rows.select(F.col("source").alias("s"), F.col("id").cast("string").alias("i"))
    lost = refs.join(have, (refs.source == have.s) & (refs.n == have.i), "left_anti")
    return lost.groupBy("id").agg(F.count("*").alias("n_unknown"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.sentence_rows(docs(spark, sf_dir), "id", F.col("text"))


#: Marks sentence ends that white space follows, for engines without look-behind.
SENT_SQL = """lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM documents),
parts AS (SELECT id, ln, string_split(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)) AS ps FROM lines),
sents AS (SELECT id, trim(s) AS sentence, ln * 100000 + pn AS pos FROM (SELECT id, ln, unnest(list_filter(ps, lambda x: trim(x) <> '')) AS s, unnest(range(0, len(list_filter(ps, lambda x: trim(x) <> '')))) AS pn FROM parts))"""


def evidence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.best_evidence(sentences(spark, sf_dir), "id", KEYS, 4).select("id", "rank", "score", F.md5("sentence").alias("sentence_md5"))


def signal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups found in benchmark-like sentences made of parts, orders and their priorities."""
    rows = claims(spark, sf_dir)
    found = e.signal_groups(rows, "id", e.REPRO_SIGNALS).unionByName(e.signal_groups(rows, "id", e.FAIRNESS_SIGNALS))
    return found.select("id", "grp")


CLAIMS = ("We report the learning rate and batch size.", "The code is on github.", "It does not report the optimizer.", "Accuracy is compared to a baseline on the test set.", "No checkpoint is available.", "All runs use the same budget.", "The limitation is a single dataset.")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    forms = F.array(*[F.lit(x) for x in CLAIMS])
    return part.select("id", F.posexplode(F.array(F.element_at(forms, (F.col("id") % 7 + 1).cast("int")), F.element_at(forms, (F.col("p_size") % 7 + 1).cast("int")))).alias("pos", "sentence"))


CLAIM_SQL = f"""forms AS (SELECT [{', '.join("'" + x + "'" for x in CLAIMS)}] AS f),
cl AS (SELECT p_partkey AS id, 0 AS pos, f[CAST(p_partkey % 7 + 1 AS INT)] AS sentence FROM part, forms UNION ALL SELECT p_partkey, 1, f[CAST(p_size % 7 + 1 AS INT)] FROM part, forms)"""


def specific_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).groupBy("id").agg(F.count_if(F.col("sentence").rlike(e.SPECIFIC)).alias("n_specific"), F.count("*").alias("n"))


def key_figure_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first figure of each (label, value), by section and then place."""
    line = load(spark, sf_dir, "lineitem")
    names = F.element_at(F.array(*[F.lit(x) for x in ("results", "abstract", "conclusion", "appendix")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = line.select(F.concat(F.lit("Flag "), "l_returnflag").alias("label"), F.col("l_quantity").cast("int").cast("string").alias("value"), names.alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    place = F.when(F.col("section") == "results", 0).when(F.col("section") == "abstract", 1).when(F.col("section") == "conclusion", 2).otherwise(99)
    best = rows.groupBy(F.lower(F.trim("label")).alias("k"), F.lower(F.trim("value")).alias("v")).agg(F.min(F.struct(place.alias("prio"), "pos", "section")).alias("best"))
    return best.select(F.col("k").alias("label"), F.col("v").alias("value"), F.col("best.section").alias("section"), F.col("best.pos").alias("pos"))


def section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored document of each source and language, as of fields that chunks compete for."""
    rows = docs(spark, sf_dir).withColumn("score", e.field_score(F.col("text")))
    return rows.groupBy("source", "lang").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


def pairwise_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of neighbouring parts by dimension: specific evidence, confidence and verdict decide."""
    prof = claims(spark, sf_dir).groupBy("id").agg(F.count_if(F.col("sentence").rlike(e.SPECIFIC)).alias("n"))
    dims = prof.select("id", F.explode(F.array(F.lit("strengths"), F.lit("novelty"))).alias("dimension"), "n")
    scored = dims.select("id", "dimension", (F.col("n") + F.when(F.col("dimension") == "novelty", F.col("id") % 3).otherwise(2)).alias("score"))
    other = scored.select((F.col("id") - 1).alias("id"), "dimension", F.col("score").alias("score_b"))
    judged = F.when(F.col("score") > F.col("score_b"), "A").when(F.col("score") < F.col("score_b"), "B").otherwise("comparable")
    return scored.join(other, ["id", "dimension"]).select("id", "dimension", "score", "score_b", judged.alias("judgement"))


def title_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that can be a title: 20 to 200 characters, no refused word, a capitalised word."""
    lines = docs(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", text.collapse_space("line"))
    fit = lines.filter(F.length("line").between(20, 200) & ~F.lower("line").rlike("^(we |this paper|in this work|in this paper|abstract|introduction|here we)") & F.col("line").rlike("[A-Z][a-z]{2,}")
                       & ~b.has_any(F.lower("line"), ("accuracy", "table", "figure", "baseline", "performance", "evaluate", "experiment", "section", "appendix")))
    return fit.groupBy("id").agg(F.min("pos").alias("pos"), F.md5(F.min_by("line", "pos")).alias("title_md5"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three valid turns of each conversation."""
    return g.last_valid(turns(spark, sf_dir), "conv_id", "turn", F.length("answer") >= 80, 3).select("conv_id", "turn", "back")


def chat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.length("answer") >= 80).alias("valid"), F.count_if(F.length("answer") < 80).alias("failed"), F.round(F.avg(F.length("answer")), 6).alias("avg_size"), F.max("turn").alias("last_turn"))


def execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sub-queries: the batch of a turn is its depth in the dependency on the turn before it by role."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    batched = rows.withColumn("batch", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order))
    return g.in_order(batched.select(F.concat_ws(":", "conv_id", "batch").alias("step"), "turn", "role"), "step", "turn", F.col("role"), ">", "members")


def quiz_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given and right options compared without their letters."""
    part = load(spark, sf_dir, "part")
    given = F.concat(F.element_at(F.array(F.lit("A. "), F.lit("b) "), F.lit(""), F.lit("C) ")), (F.col("p_partkey") % 4 + 1).cast("int")), F.upper("p_type"))
    right = F.when(F.col("p_size") % 5 == 0, F.lit("none")).otherwise(F.col("p_type"))
    return part.groupBy("p_brand").agg(F.count_if(text.quiz_answer(given) == text.quiz_answer(right)).alias("score"), F.count("*").alias("total"))


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the last day, the last 200 of them by user."""
    ev = load_events(spark, sf_dir)
    fresh = ev.join(F.broadcast(ev.agg(F.max("ts").alias("now"))), F.col("ts") > F.col("now") - F.expr("interval 1 day"))
    latest = fresh.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    return latest.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("user_id", "event_id", text.embedding_key(F.col("user_id").cast("string")).alias("cache_key"))


def rolling_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and tokens of each user in the hour before every event; an event exactly an hour old still counts."""
    seconds = F.unix_micros("ts")
    hour = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3_600_000_000, 0)
    ev = load_events(spark, sf_dir)
    return ev.select("event_id", F.count("*").over(hour).alias("requests"), F.sum(F.floor("value")).over(hour).alias("tokens"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error before each event of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load_events(spark, sf_dir).select("event_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w).alias("last_error"))


def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with no pause over two hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > 7_200_000_000
    marked = load_events(spark, sf_dir).withColumn("fresh", F.coalesce(pause, F.lit(True)).cast("int"))
    return marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


QUERIES = {
    "sliding_chunks": sliding_chunks, "word_chunks": word_chunks, "paragraphs": paragraphs, "chunk_rank": chunk_rank, "keywords_per_chunk": keywords_per_chunk, "content_kinds": content_kinds,
    "table_structure": table_structure, "response_quality": response_quality, "number_grounding": number_grounding, "nearest_element": nearest_element, "unknown_refs": unknown_refs,
    "evidence_top": evidence_top, "signal_groups": signal_groups, "specific_counts": specific_counts, "key_figure_dedup": key_figure_dedup, "section_merge": section_merge,
    "pairwise_compare": pairwise_compare, "title_score": title_score, "context_window_turns": context_window, "chat_stats": chat_stats, "execution_plan": execution_plan, "quiz_grade": quiz_grade,
    "ttl_cache": ttl_cache, "rolling_usage": rolling_usage, "carry_forward": carry_forward, "gaps_islands": gaps_islands,
}

WORDS_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
CHUNK_SQL = f"""w AS (SELECT doc_id AS id, source, {WORDS_SQL} AS ws FROM documents),
ch AS (SELECT id, source, unnest(range(0, CAST(ceil(len(ws) / 120.0) AS INT))) AS chunk_no, ws FROM w WHERE len(ws) > 0),
chunks AS (SELECT id, source, chunk_no, array_to_string(ws[chunk_no * 120 + 1 : chunk_no * 120 + 150], ' ') AS chunk FROM ch)"""
SPACE = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"
SPECIFIC_SQL = e.SPECIFIC
ORACLES = {
    "sliding_chunks": """WITH s AS (SELECT doc_id AS id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 900)) AS start FROM documents), c AS (SELECT id, CAST(start // 900 AS INT) AS chunk_no, substr(text, start + 1, 1200) AS chunk FROM s)
        SELECT id, chunk_no, md5(chunk) AS chunk_md5, length(chunk) AS size FROM c WHERE length(chunk) >= 200""",
    "word_chunks": f"WITH {CHUNK_SQL} SELECT id, chunk_no, md5(chunk) AS chunk_md5, substr(md5(concat(id, '_text_', chunk_no)), 1, 16) AS chunk_id FROM chunks",
    "paragraphs": """WITH p AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 160) AS ps, trim(replace(text, chr(10), chr(10) || chr(10)), ' ') AS whole FROM documents),
        q AS (SELECT id, CASE WHEN len(ps) > 0 THEN ps WHEN whole <> '' THEN [whole] ELSE [] END AS ps FROM p) SELECT id, CAST(unnest(range(0, len(ps))) AS INT) AS pos, md5(unnest(ps)) AS p_md5 FROM q""",
    "chunk_rank": f"""WITH {CHUNK_SQL}, s AS (SELECT *, CAST(contains(chunk, '##') AS INT) + {' + '.join(f"CAST(contains(lower(chunk), '{w}') AS INT)" for w in c.PRIORITY)} AS score FROM chunks),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id, chunk_no) AS rank FROM s) SELECT source, rank, id, chunk_no, score FROM r WHERE rank <= 28""",
    "keywords_per_chunk": """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')) AS word FROM documents), n AS (SELECT id, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 5""",
    "content_kinds": f"""SELECT CASE WHEN {any_sql('lower(text)', ('method', 'approach', 'algorithm', 'procedure'))} THEN 'methodology' WHEN {any_sql('lower(text)', ('result', 'experiment', 'evaluation', 'performance'))} THEN 'results'
        WHEN {any_sql('lower(text)', ('introduction', 'background', 'motivation'))} THEN 'introduction' WHEN {any_sql('lower(text)', ('conclusion', 'summary', 'future work'))} THEN 'conclusion' ELSE 'general' END AS kind, lang, count(*) AS n FROM documents GROUP BY ALL""",
    "table_structure": """WITH t AS (SELECT doc_id AS id, string_split(trim(text, ' '), chr(10)) AS lines FROM documents WHERE contains(text, '|')),
        c AS (SELECT *, list_filter(list_transform(string_split(lines[1], '|'), lambda x: trim(x, ' ')), lambda x: x <> '') AS cells FROM t)
        SELECT id, len(list_filter(lines, lambda x: contains(x, '|') AND NOT starts_with(trim(x, ' '), '|-'))) AS n_rows, len(cells) AS n_cols, cells[1] AS first_header FROM c""",
    "response_quality": f"""WITH {TURNS_SQL}, v AS (SELECT *, list_distinct({SPACE.format(c='question')}) AS q, list_distinct({SPACE.format(c='answer')}) AS r, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda t: t <> '')) AS nw, len(regexp_split_to_array(answer, '[.!?]+')) AS ns FROM turns),
        s AS (SELECT conv_id, turn, CASE WHEN length(trim(answer, ' ')) > 100 THEN least(1.0, length(answer) / 500) ELSE 0.0 END AS a, least(1.0, len(list_intersect(q, r)) / greatest(len(q), 1)) AS b, 1.0 / (1 + nw / greatest(ns, 1) / 20) AS c,
          CASE WHEN length(answer) > 1000 THEN greatest(0.5, 1.0 - (length(answer) - 1000) / 2000) ELSE 1.0 END AS d FROM v)
        SELECT conv_id, turn, round(a, 6) AS completeness, round(b, 6) AS relevance, round(c, 6) AS clarity, round(d, 6) AS conciseness, round((a + b + c + d) / 4, 6) AS overall FROM s""",
    "number_grounding": f"""WITH {TURNS_SQL}, n AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(answer, '[0-9]+(?:\\.[0-9]+)?')) AS a, regexp_extract_all(question, '[0-9]+(?:\\.[0-9]+)?') AS q FROM turns),
        l AS (SELECT conv_id, turn, list_sort(list_filter(a, lambda x: NOT list_contains(q, x))) AS lone FROM n) SELECT conv_id, turn, len(lone) AS n_unsupported, array_to_string(lone, ',') AS unsupported, CASE WHEN len(lone) > 0 THEN 0.7 ELSE 1.0 END AS confidence FROM l""",
    "nearest_element": """WITH k AS (SELECT DISTINCT p_brand, p_size AS have FROM part WHERE p_size % 3 = 0), r AS (SELECT DISTINCT p_brand, p_size AS ref FROM part WHERE p_size % 3 <> 0)
        SELECT p_brand, ref, first(have ORDER BY abs(have - ref), have) AS nearest FROM r JOIN k USING (p_brand) GROUP BY p_brand, ref""",
    "unknown_refs": """WITH r AS (SELECT doc_id AS id, source, unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}'))) AS n FROM documents)
        SELECT id, count(*) AS n_unknown FROM r WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = r.source AND CAST(d.doc_id AS VARCHAR) = r.n) GROUP BY id""",
    "evidence_top": f"""WITH {SENT_SQL}, s AS (SELECT *, len(regexp_extract_all(sentence, '[0-9]')) * 4 + 3 * ({' + '.join(f"CAST(contains(lower(sentence), '{k}') AS INT)" for k in KEYS)}) + 2 * CAST(contains(sentence, '%') AS INT)
          + 2 * CAST({any_sql('lower(sentence)', ('not ', 'only ', 'missing', 'limited', 'unclear'))} AS INT) + CAST(length(sentence) > 40 AS INT) AS score FROM sents),
        o AS (SELECT id, max(score) AS score, min(pos) AS pos, min_by(sentence, pos) AS sentence FROM s GROUP BY id, lower(sentence)),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM o) SELECT id, rank, score, md5(substr(sentence, 1, 160)) AS sentence_md5 FROM r WHERE rank <= 4""",
    "signal_groups": f"WITH {CLAIM_SQL}, ok AS (SELECT id, lower(sentence) AS low FROM cl WHERE NOT regexp_matches(lower(sentence), '{e.NEGATION}')) " + " UNION ".join(
        f"SELECT id, '{k}' AS grp FROM ok WHERE {any_sql('low', w)}" for k, w in (e.REPRO_SIGNALS | e.FAIRNESS_SIGNALS).items()),
    "specific_counts": f"WITH {CLAIM_SQL} SELECT id, count(*) FILTER (regexp_matches(sentence, '{SPECIFIC_SQL}')) AS n_specific, count(*) AS n FROM cl GROUP BY id",
    "key_figure_dedup": """WITH r AS (SELECT lower('Flag ' || l_returnflag) AS label, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value, ['results', 'abstract', 'conclusion', 'appendix'][CAST(l_linenumber % 4 + 1 AS INT)] AS section, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
        k AS (SELECT *, row_number() OVER (PARTITION BY label, value ORDER BY CASE section WHEN 'results' THEN 0 WHEN 'abstract' THEN 1 WHEN 'conclusion' THEN 2 ELSE 99 END, pos) AS n FROM r) SELECT label, value, section, pos FROM k WHERE n = 1""",
    "section_merge": f"""WITH s AS (SELECT doc_id AS id, source, lang, CASE WHEN text IS NULL OR lower(trim(text, ' ')) IN ('', 'not found') THEN 0.0 ELSE length(text) * 0.5 + len(regexp_extract_all(text, '[0-9]+')) * 8 + (length(text) - length(replace(text, '%', ''))) * 15
          + (length(text) - length(replace(text, '±', ''))) * 10 - CASE WHEN {' OR '.join(f"starts_with(lower(trim(text, ' ')), '{o}')" for o in e.GENERIC_OPENERS)} THEN 20 ELSE 0 END END AS score FROM documents)
        SELECT source, lang, first(id ORDER BY score DESC, id) AS id, max(score) AS score FROM s GROUP BY ALL""",
    "pairwise_compare": f"""WITH {CLAIM_SQL}, p AS (SELECT id, count(*) FILTER (regexp_matches(sentence, '{SPECIFIC_SQL}')) AS n FROM cl GROUP BY id),
        s AS (SELECT id, 'strengths' AS dimension, n + 2 AS score FROM p UNION ALL SELECT id, 'novelty', n + id % 3 FROM p)
        SELECT a.id, a.dimension, a.score, b.score AS score_b, CASE WHEN a.score > b.score THEN 'A' WHEN a.score < b.score THEN 'B' ELSE 'comparable' END AS judgement FROM s a JOIN s b ON a.id = b.id - 1 AND a.dimension = b.dimension""",
    "title_score": f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS pos FROM documents), n AS (SELECT id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l),
        f AS (SELECT * FROM n WHERE length(line) BETWEEN 20 AND 200 AND NOT regexp_matches(lower(line), '^(we |this paper|in this work|in this paper|abstract|introduction|here we)') AND regexp_matches(line, '[A-Z][a-z]{{2,}}')
          AND NOT {any_sql('lower(line)', ('accuracy', 'table', 'figure', 'baseline', 'performance', 'evaluate', 'experiment', 'section', 'appendix'))})
        SELECT id, min(pos) AS pos, md5(min_by(line, pos)) AS title_md5 FROM f GROUP BY id""",
    "context_window_turns": f"WITH {TURNS_SQL}, r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns WHERE length(answer) >= 80) SELECT * FROM r WHERE back <= 3",
    "chat_stats": f"WITH {TURNS_SQL} SELECT count(*) AS n, count(*) FILTER (length(answer) >= 80) AS valid, count(*) FILTER (length(answer) < 80) AS failed, round(avg(length(answer)), 6) AS avg_size, max(turn) AS last_turn FROM turns",
    "execution_plan": """WITH b AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS batch FROM conversations)
        SELECT concat(conv_id, ':', CAST(batch AS BIGINT)) AS step, string_agg(role, '>' ORDER BY turn, role) AS members FROM b GROUP BY ALL""",
    "quiz_grade": """WITH q AS (SELECT p_brand, regexp_replace(trim(['A. ', 'b) ', '', 'C) '][CAST(p_partkey % 4 + 1 AS INT)] || upper(p_type)), '^[A-Da-d][.)]\\s*', '') AS given, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE p_type END AS answer FROM part)
        SELECT p_brand, count(*) FILTER (lower(trim(given)) = lower(trim(answer))) AS score, count(*) AS total FROM q GROUP BY p_brand""",
    "ttl_cache": """WITH f AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY), l AS (SELECT user_id, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id, max(ts) AS ts FROM f GROUP BY user_id ORDER BY ts DESC, event_id DESC LIMIT 200)
        SELECT user_id, event_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 24) AS cache_key FROM l""",
    "rolling_usage": "SELECT event_id, count(*) OVER w AS requests, CAST(sum(floor(value)) OVER w AS BIGINT) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)",
    "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events",
    "gaps_islands": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m) SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY ALL""",
}
