"""Formulas in text: found between dollar signs, cleaned for display, and repaired from extracted text, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r"(?s)\$\$(.+?)\$\$"
INLINE = r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"
MATHS = r"[=+\-*/^_\\{}]"
NUMBER_AT_END = r"\(\s*\d{1,3}[a-z]?\s*\)\s*$"


def command(letter: str) -> str:
    """The command of a Greek letter, by its name."""
    words = unicodedata.name(letter).split()
    name = words[-1].replace("LAMDA", "LAMBDA").lower()
    return "\\" + (name.capitalize() if "CAPITAL" in words else name)


# The letters and signs that have commands, the operators that take a blank, the letters that become subscripts of p,
# and the names of functions and operators.
GREEK = tuple((letter, command(letter)) for letter in "αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ")
SIGNS = (
    ("∑", r"\sum"), ("∏", r"\prod"), ("∫", r"\int"), ("√", r"\sqrt"), ("±", r"\pm"), ("∂", r"\partial"), ("∇", r"\nabla"), ("∞", r"\infty"), ("≈", r"\approx"), ("≠", r"\neq"), ("≤", r"\leq"), ("≥", r"\geq"),
    ("∝", r"\propto"), ("∈", r"\in"), ("∉", r"\notin"), ("⊂", r"\subset"), ("⊆", r"\subseteq"), ("∪", r"\cup"), ("∩", r"\cap"), ("→", r"\rightarrow"), ("←", r"\leftarrow"), ("↔", r"\leftrightarrow"),
    ("⊕", r"\oplus"), ("⊗", r"\otimes"), ("⊤", r"\top"), ("‖", r"\|"), ("⟨", r"\langle"), ("⟩", r"\rangle"), ("·", r"\cdot"), ("×", r"\times"), ("÷", r"\div"),
)
BIG = ("sum", "int", "prod", "lim", "sup", "inf")
SUBSCRIPTS = ("alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho", "sigma", "tau", "phi", "varphi", "psi", "omega")
FUNCTIONS = ("exp", "log", "sin", "cos", "tan", "max", "min", "lim")
OPERATORS = ("argmax", "argmin", "softmax")
#: Rules of display, in order: fences and dollar signs around, a number at the end, signs of one meaning, broken characters.
DISPLAY = (
    (r"^```latex\s*", ""), (r"^```\s*", ""), (r"\s*```$", ""), (r"^\$\$", ""), (r"\$\$$", ""), (r"^\$", ""), (r"\$$", ""), (NUMBER_AT_END, ""),
    ("[−–—]", "-"), ("[∣│¦]", "|"), ("[⋅·]", r"\\cdot "), ("⊤", r"^\\top "), ("[\ufffd\x00\x01]", ""), (r"\s+", " "),
)


def rules(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def for_display(c: Column) -> Column:
    return F.trim(rules(stripped(c), DISPLAY))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times, with the value computed once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def with_commands(c: Column) -> Column:
    """A fold over the pairs, as one replacement inside another for each would be too deep."""
    pairs = F.array(*[F.struct(F.lit(a).alias("sign"), F.lit(b).alias("command")) for a, b in GREEK + SIGNS])
    return F.aggregate(pairs, c, lambda x, p: F.replace(x, p["sign"], p["command"]))


def balanced(c: Column) -> Column:
    """Closing braces, brackets and parentheses that are missing are put at the end; of braces and parentheses too many, those at the very end go."""
    def pair(x: Column, left: str, right: str, cut: bool) -> Column:
        count = lambda mark: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
        lacking = count(left) - count(right)
        added = F.concat(x, F.repeat(F.lit(right), F.greatest(lacking, F.lit(0))))
        if not cut:
            return added
        tail = F.length(F.regexp_extract(x, f"(\\{right}*)$", 1))
        return F.when(lacking < 0, F.substring(x, F.lit(1), F.length(x) - F.least(-lacking, tail))).otherwise(added)

    braces = let(c, lambda x: pair(x, "{", "}", True))
    round_ = let(braces, lambda x: pair(x, "(", ")", True))
    return let(round_, lambda x: pair(x, "[", "]", False))


def spaced_right(c: Column) -> Column:
    """Commands for signs, no blanks inside parentheses and around bars and commas, bounds of sums, subscripts of p, and single letters that belong together."""
    letters = (r"(?U)\b([a-zA-Z])\s+([a-z])\b", "$1_$2")
    whole = r"\\sum\s+([a-z])\s*=\s*(\d+)\s+([a-zA-Z])\s+(.+)"

    def bounds(tight: Column) -> Column:
        part = lambda g: F.regexp_extract(tight, whole, g)
        before = F.regexp_extract(tight, r"(?s)^(.*?)" + whole, 1)
        summed = F.concat(before, F.lit(r"\sum_{"), part(1), F.lit("="), part(2), F.lit("}^{"), part(3), F.lit("} "), rules(part(4), (letters,)))
        return F.when(tight.rlike(whole), summed).otherwise(F.regexp_replace(tight, r"\\sum\s+([a-z])\s*=\s*(\d+)\s+([a-zA-Z])", r"\\sum_{$1=$2}^{$3}"))

    def joined(named: Column) -> Column:
        words = F.filter(F.split(named, r"\s+"), lambda w: w != "")
        single = F.size(F.filter(words, lambda w: F.length(w) == 1)) / F.size(words)
        return F.when((F.size(words) > 5) & (single > 0.5), rules(named, (letters,))).otherwise(named)

    tight = rules(with_commands(c), ((r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+\|", "|"), (r"\|\s+", "|"), (r",\s+", ","), (r"\s+,", ","), (rf"\\({'|'.join(BIG)})([a-zA-Z])", r"\\$1 $2")))
    named = F.regexp_replace(let(tight, bounds), rf"(?U)(?<![_{{])p\\({'|'.join(SUBSCRIPTS)})\b", r"p_\\$1")
    return let(named, joined)


def common_errors(c: Column) -> Column:
    """Doubled backslashes, commands that run into a capital, subscripts and powers without braces, names of functions and operators without a backslash, runs of space."""
    found = (
        (r"\\\\([a-zA-Z])", r"\\$1"), (r"\\([a-z]+)([A-Z])", r"\\$1 $2"), (r"_([a-zA-Z0-9]{2,})", r"_{$1}"), (r"\^([a-zA-Z0-9]{2,})", r"^{$1}"),
        *((rf"(?iU)\b{f}\s*\(", rf"\\{f}(") for f in FUNCTIONS), *((rf"(?iU)\b{o}\b", rf"\\operatorname{{{o}}}") for o in OPERATORS),
        (r"\s+", " "),
    )
    return F.trim(rules(c, found))


def repaired(c: Column) -> Column:
    """(latex, valid): text with commands and structure is only balanced and mended, other text is given commands first; a number in brackets at the end goes."""
    without = lambda x: stripped(F.regexp_replace(x, NUMBER_AT_END, ""))

    def mended(text: Column) -> Column:
        formed = F.contains(text, F.lit("\\")) & text.rlike(r"[_^{}]")
        full = without(balanced(common_errors(with_commands(spaced_right(text)))))
        out = F.when(stripped(text) == "", "").when(formed, common_errors(without(balanced(stripped(text))))).otherwise(full)
        return let(out, lambda x: F.struct(x.alias("latex"), ((stripped(text) != "") & (formed | x.rlike(r"\\|[=+\-*/^_]"))).alias("valid")))

    return let(F.coalesce(c, F.lit("")), mended)


def formulas(docs: DataFrame) -> DataFrame:
    """(id, block, k, latex, context) of documents (id, text): what stands between double dollar signs, with up to 60 characters of the 80 before it, and between single ones where it
    has a sign of mathematics; of more than two characters both."""
    held = lambda pattern, g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
    # the text before a match: the match before it and what stands between, and so on to the front
    parts, whole = F.split("text", BLOCK, -1), held(BLOCK, 0)
    blocks = docs.select("id", parts.alias("parts"), whole.alias("whole"), F.posexplode(held(BLOCK, 1)).alias("k", "latex"))
    earlier = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.get("parts", F.lit(0)), lambda x, j: F.right(F.concat(x, F.get("whole", j - 1), F.get("parts", j)), F.lit(80)))
    earlier = F.when(F.col("k") > 0, earlier).otherwise(F.get("parts", F.lit(0)))
    near = F.regexp_replace(stripped(F.right(earlier, F.lit(80))), "\n", " ")
    blocks = blocks.select("id", F.lit(True).alias("block"), "k", stripped(F.col("latex")).alias("latex"), F.right(near, F.lit(60)).alias("context"))
    inline = docs.select("id", F.posexplode(held(INLINE, 1)).alias("k", "latex")).select("id", F.lit(False).alias("block"), "k", stripped(F.col("latex")).alias("latex"), F.lit("").alias("context")).filter(F.col("latex").rlike(MATHS))
    return blocks.unionByName(inline).filter(F.length("latex") > 2)


def new_formulas(known: DataFrame, found: DataFrame) -> DataFrame:
    """Of the found blocks (id, block, k, latex, context) the first of each formula that its document is not known (id, latex) to have."""
    fresh = found.filter("block").join(known.select("id", F.trim("latex").alias("latex")).distinct(), ["id", "latex"], "left_anti")
    return fresh.groupBy("id", "latex").agg(F.min("k").alias("k"), F.min_by("context", "k").alias("context")).select("id", "k", "latex", F.when(F.col("context") == "", "Equation from paper body").otherwise(F.col("context")).alias("description"))
