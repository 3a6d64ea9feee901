"""String and identifier functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def title_spaced(c: Column | str) -> Column:
    """Title normaliser A: punctuation becomes a space, runs of space collapse."""
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9 ]", " "), " +", " "))


def title_deleted(c: Column | str) -> Column:
    """Title normaliser B: punctuation is deleted, space stays as it is."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9 ]", ""))


def title_tokens(c: Column | str) -> Column:
    """Distinct tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(title_spaced(c), " "), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalize_doi(c: Column | str) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"^https?://(dx\.)?doi\.org/", "")
    return F.trim(F.replace(bare, F.lit("doi:"), F.lit("")))


# The forms of an arXiv identifier.
ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arXiv:)\s*([0-9]{4}\.[0-9]{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Za-z-]+)?/\d{7}(?:v\d+)?)"


def arxiv_id(c: Column | str) -> Column:
    found = F.regexp_extract(F.replace(F.coalesce(col(c), F.lit("")), F.lit(" "), F.lit("")), ARXIV, 1)
    return F.regexp_replace(F.lower(found), r"v\d+$", "")


def openalex_id(c: Column | str) -> Column:
    tail = F.element_at(F.split(F.trim(F.coalesce(col(c), F.lit(""))), "/"), -1)
    return F.trim(F.element_at(F.split(tail, r"\?"), 1))


def publication_year(c: Column | str) -> Column:
    head = F.substring(F.trim(col(c)), 1, 4)
    year = F.when(head.rlike("^[0-9]{4}$"), head.cast("int"))
    return F.when((year >= 1000) & (year <= 3000), year)


def anchor_strength(title: Column, phrase: Column) -> Column:
    """How far a normalised title instantiates a normalised phrase of four words or more."""
    words = lambda c: F.size(F.split(c, " "))
    extra = words(title) - words(phrase)
    usable = (phrase != "") & (words(phrase) >= 4) & (title != "")
    return (F.when(~usable, 0.0).when(title == phrase, 1.0)
            .when(F.startswith(title, F.concat(phrase, F.lit(" "))), F.when(extra <= 2, 1.0).when(extra <= 5, 0.48).otherwise(0.22))
            .when(F.contains(title, phrase), 0.35).otherwise(0.0))


def tokens_long(c: Column | str) -> Column:
    """Lower-case alphanumeric tokens of three characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)


def tokens_all(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def tokens_symbols(c: Column | str) -> Column:
    """Unicode word characters with ``- . ( )`` kept inside a token."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)[\w\-.()]+"), F.lit(0))


def tokens_space(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda t: t != "")


def tokens_content(c: Column | str, stop: tuple[str, ...], most: int = 10) -> Column:
    """The first ``most`` distinct tokens of three characters or more that are no stop word."""
    kept = F.filter(tokens_all(c), lambda t: (F.length(t) > 2) & ~t.isin(*stop))
    return F.slice(F.array_distinct(kept), 1, most)


def relation_type(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.replace(F.upper(F.trim(col(c))), F.lit(" "), F.lit("_")), F.lit("")), F.lit("RELATED_TO"))


def initials(c: Column | str) -> Column:
    """First letters of the words and hyphen parts, in upper case."""
    parts = F.filter(F.split(F.trim(col(c)), r"[\s\-]+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))


def sentences(c: Column | str) -> Column:
    """Split after . ! ? and white space."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def strip_code_fences(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def bold_to_html(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\*\*(.+?)\*\*", "<b>$1</b>")


def collapse_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def truncate(c: Column | str, most: int) -> Column:
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(F.concat(F.rtrim(F.substring(col(c), 1, most - 3)), F.lit("...")))


def quiz_answer(c: Column | str) -> Column:
    """An option without its leading letter."""
    return F.lower(F.trim(F.regexp_replace(F.trim(col(c)), r"^[A-Da-d][.)]\s*", "")))


def excerpt(text: Column, term: Column, window: int = 320) -> Column:
    """The characters around the first place of the term, the beginning if it has none."""
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(at - window // 2, F.lit(1))
    return F.trim(F.substr(text, F.when(at > 0, start).otherwise(1), F.lit(window)))


def embedding_key(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 24)


def chunk_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 16)
