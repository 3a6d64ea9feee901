"""Identifier functions, query understanding, ranking and entity resolution over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import mathx, text
from corpusloom.operators import bibliometrics as b
from corpusloom.operators import querying as q
from corpusloom.operators import resolution as res
from corpusloom.plans.analytics import any_sql
from corpusloom.plans.works import DOCS_SQL, works_docs
from corpusloom.sources.tables import load

AS_OF = "2024-01-31"


def pages_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in the forms that providers give, made of page ids."""
    page = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    code = F.lpad(F.col("id").cast("string"), 5, "0")
    doi = F.concat(F.element_at(F.array(F.lit("https://doi.org/"), F.lit("DOI:"), F.lit("http://dx.doi.org/"), F.lit("")), (F.col("id") % 4 + 1).cast("int")), F.lit("10.1234/Zenodo."), code)
    link = F.concat(F.element_at(F.array(F.lit("https://arxiv.org/abs/1706."), F.lit("arXiv: 1706."), F.lit("http://arxiv.org/pdf/1706."), F.lit("https://example.org/1706.")), (F.col("id") % 4 + 1).cast("int")), code, F.when(F.col("id") % 3 == 0, "v2").otherwise(""))
    work = F.concat(F.lit("https://openalex.org/W"), F.col("id"), F.when(F.col("id") % 2 == 0, "?x=1").otherwise(""))
    return page.select("id", "url", doi.alias("doi"), link.alias("link"), work.alias("work"))


IDS_SQL = """ids AS (SELECT page_id AS id, url,
  concat(['https://doi.org/', 'DOI:', 'http://dx.doi.org/', ''][CAST(page_id % 4 + 1 AS INT)], '10.1234/Zenodo.', lpad(CAST(page_id AS VARCHAR), 5, '0')) AS doi,
  concat(['https://arxiv.org/abs/1706.', 'arXiv: 1706.', 'http://arxiv.org/pdf/1706.', 'https://example.org/1706.'][CAST(page_id % 4 + 1 AS INT)], lpad(CAST(page_id AS VARCHAR), 5, '0'), CASE WHEN page_id % 3 = 0 THEN 'v2' ELSE '' END) AS link,
  concat('https://openalex.org/W', page_id, CASE WHEN page_id % 2 = 0 THEN '?x=1' ELSE '' END) AS work FROM pages)"""


def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_ids(spark, sf_dir).select("id", text.normalize_doi("doi").alias("doi"))


def arxiv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_ids(spark, sf_dir).select("id", text.arxiv_id("link").alias("arxiv_id"), text.openalex_id("work").alias("openalex_id"))


def title_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = works_docs(spark, sf_dir)
    return docs.select("id", text.title_spaced("title").alias("spaced"), text.title_deleted("title").alias("deleted"))


def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title against the next document's, by doc_id."""
    docs = works_docs(spark, sf_dir).select("id", text.title_tokens("title").alias("a"))
    other = docs.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return docs.join(other, "id").select("id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each title instantiates its own first four words, and those of the text without the last title word."""
    docs = works_docs(spark, sf_dir).select("id", text.title_spaced("title").alias("t"))
    four = F.array_join(F.slice(F.split("t", " "), 1, 4), " ")
    inner = F.array_join(F.slice(F.split("t", " "), 2, 4), " ")
    return docs.select("id", text.anchor_strength(F.col("t"), four).alias("prefix_strength"), text.anchor_strength(F.col("t"), inner).alias("inner_strength"))


def publication_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = works_docs(spark, sf_dir)
    return docs.select("id", text.publication_year("published_date").alias("year"), text.publication_year(F.concat(F.lit("x"), "published_date")).alias("bad_year"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in the forms that the rules know, each with a whole user turn."""
    turns = load(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("turn"))
    forms = F.array(*[F.lit(x) for x in FORMS])
    return turns.select("query_id", F.concat(F.element_at(forms, (F.col("query_id") % len(FORMS) + 1).cast("int")), F.lit(" "), F.regexp_replace(F.trim("turn"), r"\s+", " ")).alias("query"))


FORMS = ("latest survey of transformers", "seminal graph papers on", "code and dataset for", "compare table 2 and 3", "show all figures", "explain equation 4", "what is", "proof of convergence bound",
         "quantum circuit", "how do these relate to", "statistics and data values", "plot the chart", "federated privacy deployment", '"quoted phrase"')
QUERY_SQL = f"""qs AS (SELECT conv_id * 100 + turn AS query_id, concat([{', '.join("'" + x + "'" for x in FORMS)}][CAST((conv_id * 100 + turn) % {len(FORMS)} + 1 AS INT)], ' ',
  regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) AS query FROM conversations WHERE role = 'user')"""


def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_texts(spark, sf_dir).select("query_id", *[c.alias(n) for n, c in q.intents(F.col("query")).items()])


def query_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_texts(spark, sf_dir).select("query_id", q.complexity(F.col("query")).alias("complexity"), q.parent_topic(F.col("query")).alias("parent_topic"))
    return rows.withColumn("variants", q.variant_cap(F.col("complexity"), True)).withColumn("literal_variants", q.variant_cap(F.col("complexity"), False))


def intent_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.element_intent(query_texts(spark, sf_dir), "query").drop("query")


def stage1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query and its first variants up to the cap of its complexity, equal normal forms once."""
    rows = query_texts(spark, sf_dir).withColumn("cap", q.variant_cap(q.complexity(F.col("query")), True))
    forms = F.array(F.col("query"), F.lower("query"), F.concat(F.col("query"), F.lit(" survey")), F.concat(F.col("query"), F.lit(" review")), F.concat(F.lit("deep "), "query"), F.concat(F.col("query"), F.lit(" benchmark")))
    listed = rows.select("query_id", "cap", F.posexplode(forms).alias("pos", "variant")).withColumn("norm", text.title_spaced("variant"))
    first = listed.groupBy("query_id", "cap", "norm").agg(F.min("pos").alias("pos"), F.min_by("variant", "pos").alias("variant"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    return ranked.filter("norm <> '' and rank <= cap").select("query_id", "rank", "variant")


# Words that feedback from a first search leaves out.
STOP = ("this", "that", "with", "from", "which", "these", "paper", "propose", "method", "model", "we", "the", "and", "for", "are", "have", "been", "can", "our", "results", "based", "using", "also", "show", "used", "two", "one",
        "new", "such", "than", "more", "their", "they", "will", "both", "were", "well", "some")


def prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 most frequent words of four letters or more that are no stop word."""
    words = works_docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("body", F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    return b.top_counts(words.filter(~F.col("term").isin(*STOP)), "term", 15)


def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in two or more of the first 15 titles (the search's own first records), best eight, without those that the benchmark asks already, at most five."""
    first = works_docs(spark, sf_dir).orderBy("id").limit(15).select("id", F.explode(F.array_distinct(text.tokens_long("title"))).alias("term"))
    best = first.groupBy("term").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "term").limit(8)
    known = load(spark, sf_dir, "benchmark").select(F.explode(text.tokens_long("text")).alias("term")).distinct()
    return best.join(known, "term", "left_anti").orderBy(F.desc("n"), "term").limit(5)


def field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    category = F.element_at(F.array(F.lit("cs.lg"), F.lit("q-bio.nc"), F.lit("stat.ml"), F.lit(None), F.lit("math.co")), (F.col("p_partkey") % 5 + 1).cast("int"))
    tags = F.array_compact(F.array(F.when(F.col("p_size") % 4 == 0, "computer science"), F.when(F.col("p_size") % 7 == 0, "cell biology"), F.when(F.col("p_size") % 3 == 0, F.lower("p_name"))))
    sources = F.split(F.when(F.col("p_partkey") % 3 == 0, "arxiv").when(F.col("p_partkey") % 3 == 1, "openalex").otherwise("arxiv,openalex"), ",")
    return part.select(F.col("p_partkey").alias("id"), q.in_scope(category, tags, sources).alias("in_scope"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = works_docs(spark, sf_dir)
    return docs.select("id", F.round(mathx.recency(F.col("published_date"), AS_OF), 6).alias("recency"), F.round(mathx.citation_blended(F.col("citations"), F.col("published_date"), 2024, 0.35), 6).alias("citation"),
                       mathx.source_confidence(F.col("source")).alias("confidence"), F.round(mathx.share_of(F.col("abstract"), "[0-9]"), 6).alias("digit_density"))


def composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of relevance, citation, recency and source with the survey penalty, best 20."""
    docs = works_docs(spark, sf_dir)
    topic, semantic = F.col("id") % 11 / 10.0, F.col("id") % 7 / 6.0
    primary = 0.75 * topic + 0.25 * semantic
    penalty = F.when(b.has_any(F.lower("title"), ("survey", "review", "overview", "tutorial")), 0.25).otherwise(0.0)
    final = 0.70 * primary + 0.14 * mathx.citation_blended(F.col("citations"), F.col("published_date"), 2024, 0.35) + 0.10 * mathx.recency(F.col("published_date"), AS_OF) + 0.06 * mathx.source_confidence(F.col("source")) - penalty
    return docs.select("id", F.round(F.greatest(final, F.lit(0.0)), 6).alias("composite")).orderBy(F.desc("composite"), "id").limit(20)


def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = works_docs(spark, sf_dir)
    return docs.select("id", "title", "abstract", "source", "citations", F.nullif(text.title_spaced("title"), F.lit("")).alias("norm_title"), F.sha2("abstract", 256).alias("doi"), text.title_tokens("title").alias("tokens")).withColumn("token_key", F.nullif(F.array_join(F.array_sort("tokens"), " "), F.lit("")))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.key_links(dedup_rows(spark, sf_dir), "norm_title")


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and what links records: title words as they are, a digest of the rest. Every text is read once, titles of equal words meet by one key."""
    rows = dedup_rows(spark, sf_dir)
    return res.checkpointed(rows.select("id", F.sha2("norm_title", 256).alias("norm_title"), "doi", "tokens", F.sha2("token_key", 256).alias("token_key")))


def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_keys(spark, sf_dir)
    links = res.key_links(rows, "norm_title").union(res.key_links(rows, "doi")).union(res.key_links(rows, "token_key")).union(res.title_links(rows, "tokens")).distinct()
    return res.clusters(rows, links)


def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_rows(spark, sf_dir)
    out = res.merged(rows, dedup_components(spark, sf_dir))
    return out.select("cluster", "members", "citations", F.length("abstract").alias("abstract_size"), "source")


def landmark_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose text no document title holds as its own words: an item's n words are looked up among the runs of n words of the titles.

    Only titles that hold an item's first words in a row are compared, so neither side is a nested loop.
    """
    items = load(spark, sf_dir, "benchmark").select("item_id", text.title_spaced("text").alias("phrase")).withColumn("lead", F.array_join(F.slice(F.split("phrase", " "), 1, 2), " "))
    words = works_docs(spark, sf_dir).select(text.title_spaced("title").alias("t")).distinct().withColumn("w", F.split("t", " "))
    leads = words.select("t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, 2), " ")))).alias("lead"))
    held = leads.join(items, "lead").filter(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("item_id").distinct()
    return items.join(held, "item_id", "left_anti").select("item_id", "phrase")


QUERIES = {
    "doi_normalize": doi_normalize, "arxiv_extract": arxiv_extract, "title_norms": title_norms, "title_jaccard": title_jaccard, "anchor_strength": anchor, "publication_year": publication_year,
    "query_intent": query_intent, "query_complexity": query_complexity, "intent_router": intent_router, "stage1_variants": stage1_variants, "prf_terms": prf_terms, "feedback_terms": feedback_terms,
    "field_filter": field_filter, "scores": scores, "composite_rank": composite_rank, "dedup_exact": dedup_exact, "dedup_components": dedup_components, "dedup_merge": dedup_merge, "landmark_anti": landmark_anti,
}

SPACED = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
TOK = "list_distinct(list_filter(string_split(" + SPACED + ", ' '), lambda t: length(t) > 1))"
ANCHOR = """CASE WHEN {p} = '' OR len(string_split({p}, ' ')) < 4 OR t = '' THEN 0.0 WHEN t = {p} THEN 1.0
 WHEN starts_with(t, {p} || ' ') THEN CASE WHEN len(string_split(t, ' ')) - len(string_split({p}, ' ')) <= 2 THEN 1.0 WHEN len(string_split(t, ' ')) - len(string_split({p}, ' ')) <= 5 THEN 0.48 ELSE 0.22 END
 WHEN contains(t, {p}) THEN 0.35 ELSE 0.0 END"""
RAW = "(CASE WHEN citations > 0 THEN least(ln(1 + citations) / ln(1001.0), 1.0) ELSE 0 END)"
CITE = f"(0.65 * {RAW} + 0.35 * (CASE WHEN citations > 0 THEN least(ln(1 + citations / (greatest(2024 - CAST(substr(published_date, 1, 4) AS INT), 0) + 0.5)) / ln(501.0), 1.0) ELSE 0 END))"
RECENT = f"exp(-0.000379 * greatest(date_diff('day', CAST(published_date AS DATE), DATE '{AS_OF}'), 0))"
PARENT = "CASE " + " ".join(f"WHEN {any_sql('lower(query)', w)} THEN '{p}'" for w, p in q.PARENT_RULES) + " ELSE 'machine learning' END"
COMPLEX = f"""CASE WHEN contains(query, '"') THEN 'narrow' WHEN n <= 2 THEN 'broad' WHEN n <= 4 THEN 'moderate' ELSE 'narrow' END"""
NWORDS = "len(list_filter(regexp_split_to_array(lower(trim(query)), '[\\s\\-_]+'), lambda t: length(t) >= 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in q.COMPLEXITY_STOP) + ")))"
VOTE = {k: "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in ws) + ")" for k, ws in q.KEYWORDS.items()}
FIRST = lambda pats: "coalesce(" + ", ".join(f"nullif(regexp_extract(low, '{p}', 1), '')" for p in pats) + ")"
DEDUP = f"""{DOCS_SQL}, r AS (SELECT id, nullif({SPACED.format(c='title')}, '') AS nt, sha256(abstract) AS doi, {TOK.format(c='title')} AS tok, citations, abstract, source FROM docs),
e AS (SELECT min(id) OVER (PARTITION BY nt) AS a, id AS b FROM r WHERE nt IS NOT NULL UNION SELECT min(id) OVER (PARTITION BY doi), id FROM r
  UNION SELECT x.id, y.id FROM r x JOIN r y ON x.id < y.id AND len(x.tok) > 0 AND len(y.tok) > 0 AND least(len(x.tok), len(y.tok)) >= 0.88 * greatest(len(x.tok), len(y.tok)) - 1e-9
    AND len(list_intersect(x.tok, y.tok)) / len(list_distinct(list_concat(x.tok, y.tok))) >= 0.88),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT id AS s, id AS v FROM r UNION SELECT s, u.b FROM reach JOIN u ON u.a = reach.v),
c AS (SELECT s AS id, min(v) AS cluster FROM reach GROUP BY s)"""

ORACLES = {
    "doi_normalize": f"WITH {IDS_SQL} SELECT id, trim(replace(regexp_replace(lower(trim(doi)), '^https?://(dx\\.)?doi\\.org/', ''), 'doi:', '')) AS doi FROM ids",
    "arxiv_extract": f"""WITH {IDS_SQL} SELECT id, regexp_replace(lower(regexp_extract(replace(link, ' ', ''), '(?i)(?:arxiv\\.org/(?:abs|pdf)/|arXiv:)\\s*([0-9]{{4}}\\.[0-9]{{4,5}}(?:v\\d+)?)', 1)), 'v\\d+$', '') AS arxiv_id,
        trim(string_split(list_last(string_split(trim(work), '/')), '?')[1]) AS openalex_id FROM ids""",
    "title_norms": f"WITH {DOCS_SQL} SELECT id, {SPACED.format(c='title')} AS spaced, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')) AS deleted FROM docs",
    "title_jaccard": f"""WITH {DOCS_SQL}, x AS (SELECT id, {TOK.format(c='title')} AS a FROM docs), y AS (SELECT id - 1 AS id, a AS b FROM x)
        SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM x JOIN y USING (id)""",
    "anchor_strength": f"""WITH {DOCS_SQL}, x AS (SELECT id, {SPACED.format(c='title')} AS t FROM docs), y AS (SELECT *, array_to_string(string_split(t, ' ')[1:4], ' ') AS p, array_to_string(string_split(t, ' ')[2:5], ' ') AS i FROM x)
        SELECT id, {ANCHOR.format(p='p')} AS prefix_strength, {ANCHOR.format(p='i')} AS inner_strength FROM y""",
    "publication_year": f"WITH {DOCS_SQL} SELECT id, CAST(substr(published_date, 1, 4) AS INT) AS year, CAST(NULL AS INT) AS bad_year FROM docs",
    "query_intent": f"WITH {QUERY_SQL} SELECT query_id, " + ", ".join(f"regexp_matches(query, '(?i){p}') AS {n}" for n, p in q.INTENTS.items()) + " FROM qs",
    "query_complexity": f"""WITH {QUERY_SQL}, w AS (SELECT *, {NWORDS} AS n FROM qs), c AS (SELECT *, {COMPLEX} AS complexity FROM w)
        SELECT query_id, complexity, {PARENT} AS parent_topic, CASE complexity WHEN 'broad' THEN 2 WHEN 'moderate' THEN 4 ELSE 5 END AS variants, CASE complexity WHEN 'broad' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS literal_variants FROM c""",
    "intent_router": f"""WITH {QUERY_SQL}, l AS (SELECT query_id, lower(trim(query)) AS low FROM qs),
        v AS (SELECT *, regexp_matches(low, '{q.CROSS}') AS x, {FIRST(q.COMPARE)} AS cmp, {FIRST(q.LIST_ALL)} AS lst, {FIRST([q.SPECIFIC['equation']])} AS e, {FIRST([q.SPECIFIC['table']])} AS t, {FIRST([q.SPECIFIC['figure']])} AS f,
          {VOTE['equation']} AS ve, {VOTE['table']} AS vt, {VOTE['figure']} AS vf FROM l),
        k AS (SELECT *, CASE WHEN e IS NOT NULL THEN 'equation' WHEN t IS NOT NULL THEN 'table' WHEN f IS NOT NULL THEN 'figure' END AS named, CASE WHEN greatest(ve, vt, vf) = 0 THEN NULL WHEN ve = greatest(ve, vt, vf) THEN 'equation' WHEN vt = greatest(ve, vt, vf) THEN 'table' ELSE 'figure' END AS voted FROM v),
        z AS (SELECT *, CASE WHEN x THEN 'cross_reference' WHEN cmp IS NOT NULL THEN 'comparison' WHEN lst IS NOT NULL THEN 'list_all' WHEN named IS NOT NULL THEN 'specific_element' ELSE coalesce(voted, 'general') END AS query_type FROM k)
        SELECT query_id, query_type, CASE WHEN x THEN NULL ELSE coalesce(cmp, lst, named, voted) END AS target_type, CASE WHEN query_type = 'specific_element' THEN CAST(coalesce(e, t, f) AS INT) END AS target_number,
        CASE query_type WHEN 'cross_reference' THEN 0.9 WHEN 'comparison' THEN 0.95 WHEN 'list_all' THEN 1.0 WHEN 'specific_element' THEN 1.0 WHEN 'general' THEN 0.7 ELSE 0.8 END AS confidence FROM z""",
    "stage1_variants": f"""WITH {QUERY_SQL}, w AS (SELECT *, {NWORDS} AS n FROM qs), c AS (SELECT *, CASE {COMPLEX} WHEN 'broad' THEN 2 WHEN 'moderate' THEN 4 ELSE 5 END AS cap FROM w),
        v AS (SELECT query_id, cap, unnest([query, lower(query), query || ' survey', query || ' review', 'deep ' || query, query || ' benchmark']) AS variant, unnest(range(0, 6)) AS pos FROM c),
        d AS (SELECT query_id, cap, {SPACED.format(c='variant')} AS norm, min(pos) AS pos, min_by(variant, pos) AS variant FROM v GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM d) SELECT query_id, rank, variant FROM r WHERE norm <> '' AND rank <= cap""",
    "prf_terms": f"WITH {DOCS_SQL}, w AS (SELECT unnest(regexp_extract_all(body, '[a-z]{{4,}}')) AS term FROM docs) SELECT term, count(*) AS n FROM w WHERE term NOT IN ({', '.join(repr(x) for x in STOP)}) GROUP BY term ORDER BY n DESC, term LIMIT 15",
    "feedback_terms": f"""WITH {DOCS_SQL}, f AS (SELECT id, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) > 2))) AS term FROM (SELECT * FROM docs ORDER BY id LIMIT 15)),
        g AS (SELECT term, count(*) AS n FROM f GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 8), k AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS term FROM benchmark)
        SELECT term, n FROM g WHERE term NOT IN (SELECT term FROM k) ORDER BY n DESC, term LIMIT 5""",
    "field_filter": f"""WITH p AS (SELECT p_partkey AS id, ['cs.lg', 'q-bio.nc', 'stat.ml', NULL, 'math.co'][CAST(p_partkey % 5 + 1 AS INT)] AS cat,
          array_to_string(list_filter([CASE WHEN p_size % 4 = 0 THEN 'computer science' END, CASE WHEN p_size % 7 = 0 THEN 'cell biology' END, CASE WHEN p_size % 3 = 0 THEN lower(p_name) END], lambda x: x IS NOT NULL), chr(10)) AS tags, p_partkey % 3 AS s FROM part)
        SELECT id, CASE WHEN cat = 'q-bio.nc' THEN false WHEN cat IN ('cs.lg', 'stat.ml') THEN NOT {any_sql('tags', q.BLOCKED_TAGS)} WHEN tags <> '' AND {any_sql('tags', q.BLOCKED_TAGS)} THEN false
        WHEN tags <> '' AND {any_sql('tags', q.ALLOWED_TAGS)} THEN true WHEN tags <> '' THEN s <> 1 WHEN s <> 1 THEN true ELSE false END AS in_scope FROM p""",
    "scores": f"""WITH {DOCS_SQL} SELECT id, round({RECENT}, 6) AS recency, round({CITE}, 6) AS citation, 0.5 AS confidence,
        round(CASE WHEN length(abstract) > 0 THEN (length(abstract) - length(regexp_replace(abstract, '[0-9]', '', 'g'))) / length(abstract) ELSE 0 END, 6) AS digit_density FROM docs""",
    "composite_rank": f"""WITH {DOCS_SQL} SELECT id, round(greatest(0.70 * (0.75 * (id % 11 / 10.0) + 0.25 * (id % 7 / 6.0)) + 0.14 * {CITE} + 0.10 * {RECENT} + 0.06 * 0.5
        - CASE WHEN {any_sql('lower(title)', ('survey', 'review', 'overview', 'tutorial'))} THEN 0.25 ELSE 0 END, 0), 6) AS composite FROM docs ORDER BY composite DESC, id LIMIT 20""",
    "dedup_exact": f"WITH {DOCS_SQL}, r AS (SELECT id, nullif({SPACED.format(c='title')}, '') AS nt FROM docs), m AS (SELECT min(id) OVER (PARTITION BY nt) AS a, id AS b FROM r WHERE nt IS NOT NULL) SELECT a, b FROM m WHERE a <> b",
    "dedup_components": f"WITH RECURSIVE {DEDUP} SELECT id, cluster FROM c",
    "dedup_merge": f"""WITH RECURSIVE {DEDUP} SELECT cluster, count(*) AS members, max(citations) AS citations, max(length(abstract)) AS abstract_size, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM r JOIN c USING (id) GROUP BY cluster""",
    "landmark_anti": f"""WITH {DOCS_SQL}, i AS (SELECT item_id, {SPACED.format(c="text")} AS phrase FROM benchmark), t AS (SELECT DISTINCT {SPACED.format(c='title')} AS t FROM docs)
        SELECT item_id, phrase FROM i WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(' ' || t || ' ', ' ' || phrase || ' '))""",
}
