"""Document text cleaning, answer cleaning, and table and equation predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings at which a paper's body ends, headings of sections, and short forms with their full forms.
STOP_HEADINGS = ("references", "bibliography", "acknowledgment", "acknowledgements", "appendix", "supplementary material", "author contributions", "ethics statement", "data availability", "conflict of interest", "funding")
SECTION_HEADINGS = ("Abstract", "Introduction", "Background", "Related Work", "Preliminaries", "Methodology", "Methods", "Approach", "Model Architecture", "Model", "Architecture", "Implementation", "Training", "Datasets",
                    "Benchmarks", "Experimental Setup", "Setup", "Experiments", "Results", "Evaluation", "Analysis", "Ablation", "Discussion", "Limitations", "Future Work", "Conclusion", "Contributions", "Key Findings",
                    "Findings", "Proposed Method")
ENTITIES = (("llms", "Large Language Models"), ("llm", "Large Language Model"), ("kg", "Knowledge Graph"), ("kgs", "Knowledge Graphs"), ("nlp", "Natural Language Processing"), ("gnn", "Graph Neural Network"),
            ("transformer", "Transformer Architecture"), ("cnn", "Convolutional Neural Network"), ("rnn", "Recurrent Neural Network"))
MATH = r"[=+*/^<>\\∑∫√≤≥±×]"


# What is taken out of a paper's text, in order.
CLEAN = ((r"\x00", ""), (r"\r\n?", "\n"), (r"(?U)(\w)-\n(\w)", "$1$2"), (r"\[(?:\s*\d+\s*(?:[-–]\s*\d+\s*)?)(?:\s*,\s*\d+\s*(?:[-–]\s*\d+\s*)?)*\]", ""), (r"\(\s*\d{4}\s*\)", ""), (r"[•▪■►◆▶●◦]", ""),
         (r"-{3,}|={3,}|_{3,}|\*{3,}", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))


def chain(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def clean_text(c: Column) -> Column:
    """NULs, line ends, hyphen joins, numbered citations, years alone in brackets, bullets, rules and runs of space. Apply the nfkc function first where forms matter."""
    return F.regexp_replace(chain(c, CLEAN), r"^\s+|\s+$", "")


def body_lines(c: Column) -> Column:
    """Text before the first line of under 60 characters that is a stop heading, numbered or not."""
    lines = F.split(c, "\n")
    heads = F.transform(lines, lambda x: (F.length(F.trim(x)) < 60) & F.trim(x).rlike(r"(?i)^(\d+\.?\s*)?(" + "|".join(STOP_HEADINGS) + ")$"))
    first = F.array_position(heads, True).cast("int")
    return F.array_join(F.when(first > 0, F.slice(lines, 1, F.greatest(first - 1, F.lit(0)))).otherwise(lines), "\n")


def expand_abbreviations(c: Column) -> Column:
    """Short forms written out, whatever their case, one after the other, the longest first."""
    return reduce(lambda x, p: F.regexp_replace(x, rf"(?i)\b{p[0]}\b", p[1]), sorted(ENTITIES, key=lambda p: -len(p[0])), c)


def distinct_lines(c: Column) -> Column:
    """Every line once; empty lines stay."""
    lines = F.transform(F.split(c, "\n"), lambda x, i: F.struct(F.trim(x).alias("k"), x.alias("v"), i.alias("i")))
    keys = F.transform(lines, lambda x: x["k"])
    kept = F.filter(lines, lambda x: (x["k"] == "") | (F.array_position(keys, x["k"]) == x["i"] + 1))
    return F.array_join(F.transform(kept, lambda x: x["v"]), "\n")


def is_equation(c: Column) -> Column:
    """Short, with an operator, no address, citation or caption, six words at most."""
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    caption = F.lower(F.trim(c)).rlike("^(figure|fig|table|algorithm)")
    return (F.length(F.trim(c)).between(3, 200)) & c.rlike(MATH) & ~c.rlike(r"https?://|www\.") & ~c.rlike(r"\[\d+\]|et al") & ~caption & (words <= 6)


def is_heading(c: Column) -> Column:
    return (F.length(F.trim(c)) <= 100) & F.trim(c).rlike(r"(?i)^(\d+(\.\d+)*\.?\s+[a-z].*|[ivx]+\.\s+[a-z].*|(abstract|introduction|related work|methods?|results|discussion|conclusions?|references))$")


def caption_noise(c: Column) -> Column:
    """Years, bracketed numbers, figure and page references."""
    return F.trim(c).rlike(r"(?i)^(19|20)\d{2}$|^\[\d+\]$|^(figure|fig\.?|table|page|p\.)\s*\d+$")


def variables(c: Column) -> Column:
    """Greek letters and single Latin letters, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[α-ω]|\b[a-zA-Z]\b"), F.lit(0))))


# What begins a section's title, the operators of a display formula, and what no formula holds or begins with.
SECTION_TITLE = r"(?i)^(\d+\.?\s+[A-Z]|[IVX]+\.?\s+[A-Z]|Abstract|Introduction|Methods|Results|Discussion|Conclusion|References)"
STRONG_OPERATORS = "[=≈≤≥∫∑∏∝→∈]"
ADDRESS = r"(?i)(https?://|www\.|doi:|arxiv:|github\.com|\.pdf)"
CAPTION_START = r"(?i)^\s*(Figure|Fig|Table|Appendix|Algorithm|Listing)\b"


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def section_title(c: Column) -> Column:
    """At most 100 characters that begin with a number, a Roman number or a usual heading."""
    held = F.regexp_replace(c, r"^\s+|\s+$", "")
    return (F.length(held) <= 100) & held.rlike(SECTION_TITLE)


def is_display_equation(c: Column) -> Column:
    """8 to 300 characters with a strong operator and six words at most; no address, citation, caption or ``id=``, no closing bracket in front."""
    held = F.regexp_replace(c, r"^\s+|\s+$", "")
    odd = held.rlike(ADDRESS) | held.rlike(r"^\[\d+\]") | held.rlike(CAPTION_START) | F.lower(held).rlike("id ?=") | F.startswith(held, F.lit(")"))
    return F.length(held).between(8, 300) & ~odd & held.rlike(STRONG_OPERATORS) & (count_of(held, r"\b[a-zA-Z]{2,}\b") <= 6)
