"""Queries over questions: expansion, profiles, routing, purposes and response modes; and over answers: cleaning and failure tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import answers as a
from corpusloom.operators import expansion as x
from corpusloom.operators import querying as q
from corpusloom.plans.analytics import any_sql
from corpusloom.plans.records import FORMS
from corpusloom.sources.tables import load


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, whole, after a form that the rules know; and the names of nations and regions, which may be acronyms."""
    turns = load(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("turn"))
    forms = F.array(*[F.lit(f) for f in FORMS])
    whole = turns.select("query_id", F.concat(F.element_at(forms, (F.col("query_id") % len(FORMS) + 1).cast("int")), F.lit(" "), F.regexp_replace(F.trim("turn"), r"\s+", " ")).alias("query"))
    nations = load(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("query_id"), F.col("n_name").alias("query"))
    regions = load(spark, sf_dir, "region").select((-101 - F.col("r_regionkey")).cast("long").alias("query_id"), F.initcap("r_name").alias("query"))
    return whole.unionByName(nations).unionByName(regions)


ASKED_SQL = f"""qs AS (SELECT conv_id * 100 + turn AS query_id, concat([{', '.join("'" + f + "'" for f in FORMS)}][CAST((conv_id * 100 + turn) % {len(FORMS)} + 1 AS INT)], ' ', regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) AS query
  FROM conversations WHERE role = 'user' UNION ALL SELECT CAST(-1 - n_nationkey AS BIGINT), n_name FROM nation UNION ALL SELECT CAST(-101 - r_regionkey AS BIGINT), CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(r_name[1]) || lower(r_name[2:]) END FROM region)"""
WORD = "[\\p{L}\\p{N}_]"
BARE = "[^\\p{L}\\p{N}_]"


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.posexplode(x.variants(F.col("query"))).alias("pos", "variant"))


def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = x.profile(F.col("query"))
    return asked(spark, sf_dir).select("query_id", p["acronym"].alias("acronym"), F.array_join(p["landmarks"], "|").alias("landmarks"), p["parent_topic"].alias("parent_topic"), F.array_join(p["broad"], "|").alias("broad"), F.array_join(p["acronym_bundle"], "|").alias("acronym_bundle"))


def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search runs: variants without near copies, keywords and complexity."""
    rows = asked(spark, sf_dir).select("query_id", "query", x.distinct_queries(x.variants(F.col("query"))).alias("queries"))
    return rows.select("query_id", F.array_join("queries", "|").alias("queries"), F.array_join(x.keywords(F.col("query")), "|").alias("keywords"), q.complexity(F.col("query")).alias("complexity"))


def failed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansions after a search whose score is the share of the query's words that are terms."""
    rows = asked(spark, sf_dir).withColumn("score", F.size(x.query_terms(F.col("query"), 1000)) / F.size(x.words(F.col("query"))))
    return rows.select("query_id", F.posexplode(x.after_failure(F.col("query"), F.col("score"), 0.9)).alias("pos", "variant"))


def query_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("query")
    return asked(spark, sf_dir).select("query_id", *[v.alias(k) for k, v in x.purposes(c).items()], x.focus_term(c).alias("focus"), F.array_join(x.query_terms(c), "|").alias("terms"), F.array_join(x.search_variants(c), "|").alias("variants"))


def query_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata field that answers a query without search, and how the answer is shown."""
    return asked(spark, sf_dir).select("query_id", x.metadata_field(F.col("query")).alias("field"), x.response_mode(F.col("query")).alias("mode"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")


def cleaned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer, said twice in part and after a prompt's trace, cleaned by the three cleaners."""
    t = F.col("text")
    noisy = F.concat(F.lit("Answer: "), t, F.lit("\n"), F.split_part(t, F.lit("\n"), F.lit(1)), F.lit("\n\n\n\nContext: "), t)
    rows = answers(spark, sf_dir).select("conv_id", "turn", noisy.alias("n"))
    return rows.select("conv_id", "turn", F.md5(a.without_repetition(F.col("n"))).alias("once_md5"), F.md5(a.without_leaks(F.col("n"))).alias("leak_md5"), F.md5(a.tidy(F.col("n"))).alias("tidy_md5"), F.md5(a.plain_summary(F.col("n"))).alias("summary_md5"))


def answer_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of answers and of provider messages made of them."""
    t = F.col("text")
    said = F.when(F.col("turn") % 4 == 1, F.lit("The document does not contain this information.")).when(F.col("turn") % 4 == 3, F.concat(F.lit("Error 429: quota. "), t)).otherwise(t)
    return answers(spark, sf_dir).withColumn("s", said).groupBy(a.looks_broken(F.col("s")).alias("broken"), a.looks_not_found(F.col("s")).alias("not_found"), a.provider_error(F.col("s")).alias("error")).agg(F.count("*").alias("n"))


def citation_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the elements of each brand: metals stand for element kinds, sizes for numbers and pages."""
    part = load(spark, sf_dir, "part")
    kind = F.when(F.contains(F.upper("p_type"), F.lit("BRASS")), "table").when(F.contains(F.upper("p_type"), F.lit("STEEL")), "figure").when(F.contains(F.upper("p_type"), F.lit("TIN")), "equation")
    cited = part.select("p_brand", a.source_citation(kind, F.col("p_size"), F.when(F.col("p_size") < 40, F.col("p_size"))).alias("c"))
    return cited.filter("c is not null").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("c")), "; ").alias("citations"), F.count("*").alias("n"))


def equation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document by the strict equation test; their size as the side of a formula with commands for letters, and how many lines are one half twice."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    shaped = lines.select("doc_id", "line", F.concat("line", F.lit(" = α + β")).alias("e"))
    return shaped.groupBy("doc_id").agg(F.count_if(a.strict_equation(F.col("line"))).alias("n_strict"), F.count_if(a.strict_equation(F.col("e"))).alias("n_shaped"), F.sum(F.length(a.to_commands(F.col("e")))).alias("size"),
                                        F.count_if(a.collapsed_double(F.col("line")) != F.col("line")).alias("n_halved"))


QUERIES = {"query_variants": query_variants, "query_profile": query_profile, "expanded_queries": expanded_queries, "failed_expansion": failed_expansion, "query_purposes": query_purposes, "query_routes": query_routes,
           "cleaned_answers": cleaned_answers, "answer_failures": answer_failures, "citation_strings": citation_strings, "equation_lines": equation_lines}


def words_in(column: str, words: tuple[str, ...]) -> str:
    return "(" + any_sql(column, words) + ")"


def names(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def first_once(listed: str, key: str) -> str:
    """Elements whose ``key`` (of e) is not that of an earlier one."""
    return f"list_filter({listed}, lambda e, i: list_position(list_transform({listed}, lambda e: {key}), {key}) = i)"


N = "len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''))"
VARIANTS = f"""list_filter([query, CASE WHEN {N} >= 3 THEN '"' || query || '"' END, CASE WHEN {N} >= 2 AND {words_in('lower(query)', x.NEURAL)} THEN 'deep ' || lower(query) END, CASE WHEN {N} >= 2 THEN query || ' survey' END,
  CASE WHEN {N} >= 4 THEN query || ' review' END], lambda v: v IS NOT NULL)"""
ACRONYM = f"({N} = 1 AND length(query) <= 7 AND (upper(query) = query OR regexp_matches(query, '^[A-Z][a-zA-Z]{{1,5}}$')))"
LONG = f"list_filter({VARIANTS}, lambda v: len(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> '')) >= 4 AND NOT starts_with(v, '\"'))"
PARENT = "CASE " + " ".join(f"WHEN {any_sql('lower(query)', w)} THEN '{p}'" for w, p in q.PARENT_RULES) + " ELSE 'machine learning' END"
KEYS = f"list_filter(regexp_split_to_array(lower(query), '[\\s\\-_]+'), lambda t: length(t) >= 2 AND t NOT IN ({names(q.COMPLEXITY_STOP)}))"
TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\W+'), lambda t: t <> ''))"
QUOTED = "(starts_with({0}, '\"') AND ends_with({0}, '\"'))"
TERMS = f"list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9\\-]{{1,}}'), lambda t: t NOT IN ({names(x.TERM_STOP)}))"
LEAD = "(?i)^(what is |what are |who is |who are |explain |define )"
FOCUS = f"""CASE WHEN regexp_matches(b, '{LEAD}') THEN regexp_replace(regexp_replace(b, '{LEAD}', ''), '^[ .]+|[ .]+$', '', 'g') ELSE trim(regexp_extract(b, '(?:about|for|of)\\s+([A-Za-z][A-Za-z0-9\\- ]{{2,}})', 1)) END"""
SUBS = [(t, w) for t, own in x.SYNONYMS.items() for w in own]
SYNONYM = "[" + ", ".join(f"CASE WHEN regexp_matches(low, '(^|{BARE}){t}($|{BARE})') THEN regexp_replace(low, '(^|{BARE}){t}($|{BARE})', '\\1{w}\\2') END" for t, w in SUBS) + "]"
SWAP = "[" + ", ".join(f"CASE WHEN contains(low, '{o}') THEN regexp_replace(low, '(^|{BARE}){o}($|{BARE})', '\\1{n}\\2') END" for o, n in (("what", "how"), ("how", "what"), ("why", "what"), ("explain", "describe"))) + "]"


def filled_sql(templates: tuple[str, ...], column: str) -> str:
    return "[" + ", ".join("concat('" + t.replace("{}", f"', {column}, '") + "')" for t in templates) + "]"


CHAINS = {
    "leak": [(f"(?is){p}", "") for p in a.LEAKS],
    "tidy": [("(?i)\\bShort Summary\\s+Short\\b", "Short Summary"), ("(?i)\\bExplanation\\s+Short\\b", "Explanation"), ("(?s)\\$\\$.*?\\$\\$", ""), ("(?s)```(?:latex|math|text)?\\n.*?```", ""), ("\\r", "\n"), ("\\n{3,}", "\n\n"), ("[ \\t]{2,}", " ")],
    "plain": [("(?is)\\bTechnical Details\\b.*$", ""), ("\\\\[A-Za-z]+", ""), ("[_^{}]", "")],
}


def chained(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, put in rules:
        column = f"regexp_replace({column}, '{pattern}', '{put}', 'g')"
    return column


SPLIT = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))"


def word_count(c: str) -> str:
    return f"len(list_filter(regexp_extract_all({c}, '{WORD}+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{2,}}')))"



def strict_sql(c: str) -> str:
    t = f"trim({c}, ' ')"
    return (f"(length({t}) BETWEEN 8 AND 300 AND NOT regexp_matches({t}, '(?i)https?://|www\\.|doi:|arxiv:|github\\.com|\\.pdf') AND NOT regexp_matches({t}, '^\\[\\d+\\]') AND NOT regexp_matches({t}, '(?i)^\\s*(Figure|Fig|Table|Appendix|Algorithm|Listing)($|{BARE})')"
            f" AND NOT regexp_matches(lower({t}), 'id ?=') AND NOT starts_with({t}, ')') AND regexp_matches({t}, '[{a.SIGNS}]') AND {word_count(t)} <= 6)")


COMMANDS = "replace(e, chr(10), ' ')"
for _letter, _command in (*a.GREEK, ("∑", "\\sum "), ("∏", "\\prod ")):
    COMMANDS = f"replace({COMMANDS}, '{_letter}', '{_command}')"

ORACLES = {
    "query_variants": f"WITH {ASKED_SQL}, v AS (SELECT query_id, {VARIANTS} AS vs FROM qs) SELECT query_id, CAST(unnest(range(0, len(vs))) AS INT) AS pos, unnest(vs) AS variant FROM v",
    "query_profile": f"""WITH {ASKED_SQL} SELECT query_id, CASE WHEN {ACRONYM} THEN upper(query) ELSE '' END AS acronym, array_to_string({LONG}[1:3], '|') AS landmarks, {PARENT} AS parent_topic, query AS broad,
        array_to_string(list_filter([CASE WHEN {ACRONYM} THEN upper(query) ELSE '' END, CASE WHEN upper(query) = query AND length(query) BETWEEN 2 AND 7 AND NOT {ACRONYM} THEN query ELSE '' END], lambda t: t <> ''), '|') AS acronym_bundle FROM qs""",
    "expanded_queries": f"""WITH {ASKED_SQL}, v AS (SELECT query_id, query, list_transform({VARIANTS}, lambda e: [e]) AS vs, {KEYS} AS ks FROM qs),
        f AS (SELECT *, list_reduce(vs, lambda k, o: CASE WHEN {QUOTED.format('o[1]')} OR len(list_filter(k, lambda e: NOT {QUOTED.format('e')} AND len(list_intersect({TOKENS.format('o[1]')}, {TOKENS.format('e')})) >= 0.85 * len(list_distinct(list_concat({TOKENS.format('o[1]')}, {TOKENS.format('e')}))))) = 0
          THEN list_concat(k, o) ELSE k END) AS kept FROM v)
        SELECT query_id, array_to_string(kept[1:8], '|') AS queries, array_to_string({first_once('ks', 'e')}[1:14], '|') AS keywords, CASE WHEN contains(query, '"') THEN 'narrow' WHEN len(ks) <= 2 THEN 'broad' WHEN len(ks) <= 4 THEN 'moderate' ELSE 'narrow' END AS complexity FROM f""",
    "failed_expansion": f"""WITH {ASKED_SQL}, l AS (SELECT query_id, query, lower(query) AS low, regexp_replace(query, '\\?+$', '') AS bare, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '') AS ws, {TERMS} AS ts,
          list_filter(regexp_extract_all(lower(query), '{WORD}+'), lambda w: regexp_full_match(w, '[a-z]+') AND length(w) > 3 AND w NOT IN ({names(x.CONCEPT_STOP)})) AS own FROM qs),
        s AS (SELECT *, len(list_distinct(ts)) / len(ws) AS score, list_filter({SYNONYM}, lambda e: e IS NOT NULL) AS syn, list_filter({SWAP}, lambda e: e IS NOT NULL) AS swaps, (regexp_matches(low, '^({'|'.join(x.QUESTION_WORDS)})') OR contains(query, '?')) AS asks,
          list_concat(list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1]), own)[1:5] AS con FROM l),
        m AS (SELECT *, flatten(list_transform(con, lambda c: {filled_sql(x.GENERAL, 'c')})) AS general, CASE WHEN len(syn) > 0 THEN syn ELSE [query] END AS syns, CASE WHEN asks THEN swaps ELSE {filled_sql(x.QUESTIONS, 'bare')} END AS refs FROM s),
        e AS (SELECT *, list_concat(list_concat(refs[1:2], syns[1:2]), [query || ' in the document']) AS every FROM m),
        v AS (SELECT query_id, CASE WHEN score < 0.45 THEN (CASE WHEN len(general) > 0 THEN general WHEN len(ws) > 3 THEN [array_to_string(ws[1:len(ws) // 2], ' ')] ELSE [] END)[1:5]
          WHEN score < 0.9 THEN {first_once('every', 'lower(trim(e))')}[1:4] ELSE syns[1:3] END AS vs FROM e) SELECT query_id, CAST(unnest(range(0, len(vs))) AS INT) AS pos, unnest(vs) AS variant FROM v""",
    "query_purposes": f"""WITH {ASKED_SQL}, b AS (SELECT *, lower(query) AS low, regexp_replace(query, '[? ]+$', '') AS b, {TERMS} AS ts FROM qs),
        f AS (SELECT *, {words_in('low', x.SUMMARY)} AS is_summary, {words_in('low', x.LIMITS)} AS is_limits, (regexp_matches(low, '^what (is|are) ') OR {words_in('low', ('defined', 'definition'))}) AS is_definition, {words_in('low', x.EXPLAIN)} AS is_explanation, {FOCUS} AS focus FROM b),
        v AS (SELECT *, list_filter([query, CASE WHEN is_summary THEN 'main findings contributions results conclusion' END, CASE WHEN is_summary THEN 'abstract key results contributions' END, CASE WHEN is_limits THEN 'limitations future work discussion conclusion' END,
          CASE WHEN is_limits THEN 'future work limitations open problems' END, CASE WHEN is_definition AND focus <> '' THEN focus END, CASE WHEN is_definition AND focus <> '' THEN focus || ' definition' END, CASE WHEN is_definition AND focus <> '' THEN 'what is ' || focus END], lambda e: e IS NOT NULL) AS vs FROM f)
        SELECT query_id, is_summary, is_limits, is_definition, is_explanation, focus, array_to_string({first_once('ts', 'e')}[1:10], '|') AS terms, array_to_string({first_once('vs', 'lower(e)')}[1:6], '|') AS variants FROM v""",
    "query_routes": f"""WITH {ASKED_SQL}, l AS (SELECT query_id, lower(query) AS low FROM qs) SELECT query_id,
        CASE WHEN contains(low, 'title') AND ({any_sql('low', ('paper', 'document'))} OR low = 'title') THEN 'title' WHEN {any_sql('low', x.WROTE)} THEN 'authors' WHEN contains(low, 'affiliation') THEN 'affiliations' WHEN {any_sql('low', x.DATED)} THEN 'year'
          WHEN contains(low, 'abstract') THEN 'abstract' WHEN contains(low, 'arxiv') AND {words_in('low', ('identifier', 'id', 'number'))} THEN 'arxiv_id' END AS field,
        CASE WHEN {words_in('low', x.COUNTS)} AND {words_in('low', x.ASSETS)} THEN 'count' WHEN {any_sql('low', x.ALL_EQUATIONS)} THEN 'all_equations' WHEN {any_sql('low', x.ALL_TABLES)} THEN 'all_tables' WHEN {any_sql('low', x.ALL_FIGURES)} THEN 'all_figures'
          WHEN {any_sql('low', x.EQUATION_WORDS)} OR regexp_matches(low, '{x.EQUATION_FORMS}') THEN 'specific_equation' WHEN {any_sql('low', x.TABLE_WORDS)} THEN 'table' WHEN {any_sql('low', x.FIGURE_WORDS)} THEN 'figure' ELSE 'general' END AS mode FROM l""",
    "cleaned_answers": f"""WITH n AS (SELECT conv_id, turn, concat('Answer: ', text, chr(10), string_split(text, chr(10))[1], chr(10), chr(10), chr(10), chr(10), 'Context: ', text) AS n FROM conversations WHERE role = 'assistant'),
        s AS (SELECT *, string_split(n, chr(10)) AS ls FROM n), l AS (SELECT *, array_to_string(list_filter(ls, lambda e, i: trim(e, ' ') = '' OR list_position(list_transform(ls, lambda e: trim(e, ' ')), trim(e, ' ')) = i), chr(10)) AS u FROM s),
        p AS (SELECT *, {SPLIT.format('u')} AS us, list_filter(list_transform({SPLIT.format('(' + chained('n', CHAINS['plain']) + ')')}, lambda e: trim(e, ' ')), lambda e: e <> '') AS ps FROM l)
        SELECT conv_id, turn, md5(array_to_string(list_filter(us, lambda e, i: length(trim(e, ' ')) < 10 OR list_position(list_transform(us, lambda e: CASE WHEN length(trim(e, ' ')) < 10 THEN NULL ELSE lower(trim(e, ' ')) END), lower(trim(e, ' '))) = i), ' ')) AS once_md5,
          md5(regexp_replace(trim({chained('n', CHAINS['leak'])}, ' '), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS leak_md5, md5(trim({chained('n', CHAINS['tidy'])}, ' ')) AS tidy_md5,
          md5(trim(array_to_string(list_filter(ps, lambda e, i: list_position(list_transform(ps, lambda e: regexp_replace(lower(e), '\\s+', ' ', 'g')), regexp_replace(lower(e), '\\s+', ' ', 'g')) = i), ' '), ' ')) AS summary_md5 FROM p""",
    "answer_failures": f"""WITH s AS (SELECT CASE WHEN turn % 4 = 1 THEN 'The document does not contain this information.' WHEN turn % 4 = 3 THEN 'Error 429: quota. ' || text ELSE text END AS s FROM conversations WHERE role = 'assistant')
        SELECT regexp_matches(s, '(?i){'|'.join(a.BROKEN)}') OR s = '' AS broken, s = '' OR contains(lower(s), '{a.NOT_FOUND}') AS not_found, CASE WHEN {any_sql('lower(s)', a.TOO_LARGE)} THEN 'too_large' WHEN {any_sql('lower(s)', a.RATE_LIMITED)} THEN 'rate_limit' END AS error, count(*) AS n FROM s GROUP BY ALL""",
    "citation_strings": """WITH k AS (SELECT p_brand, p_size, CASE WHEN contains(upper(p_type), 'BRASS') THEN 'Table' WHEN contains(upper(p_type), 'STEEL') THEN 'Figure' WHEN contains(upper(p_type), 'TIN') THEN 'Equation' END AS kind FROM part),
        c AS (SELECT p_brand, CASE WHEN kind IS NOT NULL THEN concat('(Source: ', kind, ' ', p_size, ')') WHEN p_size < 40 THEN concat('(Source: Page ', p_size, ')') END AS c FROM k)
        SELECT p_brand, string_agg(DISTINCT c, '; ' ORDER BY c) AS citations, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY p_brand""",
    "equation_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT *, line || ' = α + β' AS e FROM l)
        SELECT doc_id, count(*) FILTER ({strict_sql('line')}) AS n_strict, count(*) FILTER ({strict_sql('e')}) AS n_shaped, CAST(sum(length(CASE WHEN contains(e, chr(92)) THEN e ELSE trim({COMMANDS}, ' ') END)) AS BIGINT) AS size,
          count(*) FILTER (length(line) >= 2 AND length(line) % 2 = 0 AND substr(line, 1, length(line) // 2) = substr(line, length(line) // 2 + 1)) AS n_halved FROM s GROUP BY doc_id""",
}
