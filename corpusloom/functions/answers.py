"""Answer texts: repetition, prompt leaks, equation leaks, citations and failure tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import chain

# Traces of a prompt in an answer, repeated statements, and marks of broken and of failed answers.
LEAKS = (r"Question:\s*", r"Answer:\s*", r"Context:\s*", r"Instructions?:\s*", r"System:\s*", r"Assistant:\s*", r"User:\s*", r"\[INST\].*?\[/INST\]", r"<s>.*?</s>", r"```instructions?.*?```")
REPEATED = (r"((?:Equation|Table|Figure)\s+\d+\s+(?:is|are|shows|demonstrates)\s+[^.]+\.)\s*\1+", r"(The document (?:contains|has|includes)[^.]+\.)\s*\1+")
BROKEN = (r"Short Summary\s+Short", r"Explanation\s+Short", r"p\s*R\s*A\s*G", r"⚠️ Error generating response")
NOT_FOUND = "the document does not contain this information"
TOO_LARGE = ("request too large", "request_too_large", "too many tokens", "context_length_exceeded", "context length", "max_tokens", "payload too large", "413", "reduce the length")
RATE_LIMITED = ("rate limit", "rate_limit", "ratelimit", "429", "too many requests", "quota", "quota exceeded", "fallback model", "fallback_model", "no model available", "model unavailable", "please try again", "service unavailable", "503")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def first_places(items: Column, key, keep) -> Column:
    """The items whose key did not come before, and those that ``keep`` exempts; the order stays."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), keep(x).alias("keep"), x.alias("v")))
    keys = F.transform(keyed, lambda s: F.when(s["keep"], None).otherwise(s["k"]))
    kept = F.filter(F.transform(keyed, lambda s, i: F.struct(s["k"].alias("k"), s["keep"].alias("keep"), s["v"].alias("v"), i.alias("i"))), lambda s: s["keep"] | (F.array_position(keys, s["k"]) == s["i"] + 1))
    return F.transform(kept, lambda s: s["v"])


def distinct_lines(c: Column) -> Column:
    """Every line once, told by its trimmed text; blank lines stay."""
    return F.array_join(first_places(F.split(c, "\n"), lambda x: F.trim(x), lambda x: F.trim(x) == ""), "\n")


def distinct_sentences(c: Column) -> Column:
    """Every sentence of ten characters or more once, whatever its case."""
    return F.array_join(first_places(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.lower(F.trim(x)), lambda x: F.length(F.trim(x)) < 10), " ")


def without_repetition(c: Column) -> Column:
    return chain(distinct_sentences(distinct_lines(c)), tuple((f"(?i){p}", "$1") for p in REPEATED))


def without_leaks(c: Column) -> Column:
    return F.regexp_replace(F.trim(chain(c, tuple((f"(?is){p}", "") for p in LEAKS))), r"\n{3,}", "\n\n")


def tidy(c: Column) -> Column:
    """Doubled headings, display formulas, fenced code, line ends and runs of space."""
    return F.trim(chain(c, ((r"(?i)\bShort Summary\s+Short\b", "Short Summary"), (r"(?i)\bExplanation\s+Short\b", "Explanation"), (r"(?s)\$\$.*?\$\$", ""), (r"(?s)```(?:latex|math|text)?\n.*?```", ""), (r"\r", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "))))


def plain_summary(c: Column) -> Column:
    """Without what follows a heading of technical details, LaTeX commands and marks; each sentence once."""
    bare = chain(c, ((r"(?is)\bTechnical Details\b.*$", ""), (r"\\[A-Za-z]+", ""), (r"[_^{}]", "")))
    parts = F.filter(F.transform(F.split(bare, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.trim(F.array_join(first_places(parts, lambda x: F.regexp_replace(F.lower(x), r"\s+", " "), lambda x: F.lit(False)), " "))


def looks_broken(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + "|".join(BROKEN)) | (F.coalesce(c, F.lit("")) == "")


def looks_not_found(c: Column) -> Column:
    return (F.coalesce(c, F.lit("")) == "") | F.contains(F.lower(c), F.lit(NOT_FOUND))


def provider_error(c: Column) -> Column:
    """too_large, rate_limit or null, of a provider's message."""
    low = F.lower(c)
    return F.when(any_of(low, TOO_LARGE), "too_large").when(any_of(low, RATE_LIMITED), "rate_limit")


def source_citation(kind: Column, number: Column, page: Column) -> Column:
    """``(Source: Table 2)`` for elements, ``(Source: Page 3)`` for pages, null for neither."""
    name = F.when(kind == "table", "Table").when(kind == "figure", "Figure").when(kind == "equation", "Equation")
    return F.when(name.isNotNull(), F.concat(F.lit("(Source: "), name, F.lit(" "), F.coalesce(number.cast("string"), F.lit("?")), F.lit(")"))).when(page.isNotNull(), F.concat(F.lit("(Source: Page "), page.cast("string"), F.lit(")")))


def collapsed_double(c: Column) -> Column:
    """A text that is its own first half twice becomes that half."""
    half = F.floor(F.length(c) / 2).cast("int")
    return F.when((F.length(c) >= 2) & (F.length(c) % 2 == 0) & (F.substr(c, F.lit(1), half) == F.substr(c, half + 1, half)), F.substr(c, F.lit(1), half)).otherwise(c)


# Greek letters as commands, and the signs of a strict equation.
GREEK = (("α", "\\alpha "), ("β", "\\beta "), ("γ", "\\gamma "), ("δ", "\\delta "), ("η", "\\eta "), ("θ", "\\theta "), ("λ", "\\lambda "), ("μ", "\\mu "))
SIGNS = "=≈≤≥∫∑∏∝→∈"


def to_commands(c: Column) -> Column:
    """Plain mathematics with LaTeX commands; a text that holds a backslash stays as it is."""
    out = F.replace(c, F.lit("\n"), F.lit(" "))
    for letter, command in (*GREEK, ("∑", "\\sum "), ("∏", "\\prod "), ("�", ""), ("\x01", ""), ("\x00", "")):
        out = F.replace(out, F.lit(letter), F.lit(command))
    return F.when(F.contains(c, F.lit("\\")), c).otherwise(F.trim(out))


def strict_equation(c: Column) -> Column:
    """8 to 300 characters with a sign, no address, reference, caption or id, and six words at most."""
    t = F.trim(c)
    refused = t.rlike(r"(?i)https?://|www\.|doi:|arxiv:|github\.com|\.pdf") | t.rlike(r"^\[\d+\]") | t.rlike(r"(?i)^\s*(Figure|Fig|Table|Appendix|Algorithm|Listing)\b") | F.lower(t).rlike("id ?=") | F.startswith(t, F.lit(")"))
    return F.length(t).between(8, 300) & ~refused & t.rlike(f"[{SIGNS}]") & (F.size(F.regexp_extract_all(t, F.lit(r"\b[a-zA-Z]{2,}\b"), F.lit(0))) <= 6)
