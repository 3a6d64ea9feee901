"""Toxicity scores from a learned lexicon, misspellings and context windows.

Training learns lexicon entries from labelled rows: whole words, and stems that
begin several different words. The entries form a trie; the trie is intersected with
Levenshtein automata (one edit for words and stems of MIN_FUZZY bytes or more) and the
product is made deterministic, so that every word of every text is read once. A
misspelling that the training rows hold with a precision below MIN_PRECISION is no hit. Hits
get context: inside quotation marks or not, and how many other hits stand within
CONTEXT words. A logistic model on these features gives the score, so a quoted term
can weigh less than abuse.

Bounds: the model is fitted on at most SAMPLE_ROWS labels (the smallest by a hash of
doc_id); the lexicon keeps every term of the same support and precision at any size, in as
many automata as it takes; scoring covers every byte of every text and needs no shuffle.

Defined cases: null and empty texts have no hits and get the score that the model
gives to a text without hits; with no labels, or labels of one kind only, every score
is the share of label 1 (0 without labels); null labels and null doc_ids are not
learned from; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import keep_rows

SAMPLE_ROWS = 20_000
#: Entries that one automaton holds; a larger lexicon takes several.
ENTRIES = 512
MIN_SUPPORT = 3
MIN_PRECISION = 0.8
STEM_LENGTHS = (4, 5, 6)
STEM_WORDS = 4
MIN_FUZZY = 5
CONTEXT = 12
FUZZY_TRUST = 0.8
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"

MEMBER = np.zeros(256, dtype=bool)
MEMBER[0x30:0x3A] = True
MEMBER[0x61:0x7B] = True
MEMBER[0x80:] = True
#: Bytes of quotation marks: ASCII, and the last bytes of the curly and angle ones.
QUOTES = ("“", "”", "«", "»", "„")
FEATURES = 7


def learned_terms(texts: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that mark label 1 among (text, label) rows; distinct texts count once.

    Words stay beside the stems that cover them, and stems beside shorter ones that are too short for edits.
    """
    base = texts.filter("text is not null").select("text", F.col("label").cast("int").alias("label")).distinct()
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = base.select("label", F.array_distinct(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))).alias("words"))
    begins = F.flatten(F.array(*[F.expr(f"transform(filter(words, w -> length(w) >= {k}), w -> substring(w, 1, {k}))") for k in STEM_LENGTHS]))
    chosen_rows = (F.col("t") >= MIN_SUPPORT) & (F.col("t") >= MIN_PRECISION * F.col("n"))

    def counted(column: Column, name: str) -> DataFrame:
        rows = words.select("label", F.explode(column).alias(name))
        return rows.groupBy(name).agg(F.sum("label").alias("t"), F.count("*").alias("n")).filter(chosen_rows)

    word_terms = counted(F.col("words"), "w").filter(F.length("w") >= 3)
    found_in = words.filter("label = 1").select(F.explode("words").alias("w")).distinct()
    kinds = found_in.select(F.explode(F.array(*[F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in STEM_LENGTHS])).alias("s")).groupBy("s").agg(F.count("*").alias("kinds"))
    stem_terms = counted(F.array_distinct(begins), "s").filter(F.col("t") >= 2 * MIN_SUPPORT).join(kinds.filter(F.col("kinds") >= STEM_WORDS), "s")
    found_stems = [r.s for r in stem_terms.select("s").collect()]
    chosen: list[str] = []
    for s in sorted(found_stems, key=lambda s: (len(s), s)):
        if not any(s.startswith(c) and len(c.encode()) >= MIN_FUZZY for c in chosen):
            chosen.append(s)
    return sorted(r.w for r in word_terms.select("w").collect()), chosen


@dataclass
class Automaton:
    """A byte DFA: next state by (state, byte class), and what a word that ends there is."""

    classes: np.ndarray
    step: np.ndarray
    exact: np.ndarray
    fuzzy: np.ndarray
    longest: int
    width: int


def trie_of(entries: list[tuple[bytes, bool]]) -> tuple[list[dict[int, int]], list[int]]:
    """Children and end marks (0 none, 1 word, 2 stem) of each node."""
    children: list[dict[int, int]] = [{}]
    ends = [0]
    for text, stem in entries:
        node = 0
        for byte in text:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(0)
            node = children[node][byte]
        ends[node] = max(ends[node], 2 if stem else 1)
    return children, ends


def build_automaton(words: list[str], stems: list[str], min_fuzzy: int = MIN_FUZZY, fuzzy_stems: bool = False) -> Automaton:
    """Determinises trie x Levenshtein(1). A state is a set of (node, edits); stems absorb what follows them.

    Words of min_fuzzy bytes or more are matched with an edit, and with ``fuzzy_stems`` the words that begin with a stem
    so long and an edit in it; what follows an exact stem or word is still told from these.
    """
    entries = [(w.encode(), False) for w in words] + [(s.encode(), True) for s in stems]
    children, ends = trie_of(entries)
    far = [0] * len(children)  # nodes above some end that is long enough for an edit
    long_end, long_stem = set(), set()
    for text, stem in entries:
        if len(text) >= min_fuzzy and (fuzzy_stems or not stem):
            node = 0
            far[0] = 1
            for byte in text:
                node = children[node][byte]
                far[node] = 1
            (long_stem if stem else long_end).add(node)
    alphabet = sorted({b for text, _ in entries for b in text})
    classes = np.zeros(256, dtype=np.int32)
    for k, byte in enumerate(alphabet):
        classes[byte] = k + 1
    width = len(alphabet) + 1
    absorbed, edited = -1, -2  # pseudo nodes: a stem was read, or one with an edit

    def close(states: set[tuple[int, int]]) -> frozenset:
        out = set(states)
        for node, edits in states:
            if node >= 0 and edits == 0 and far[node]:
                out |= {(child, 1) for child in children[node].values() if far[child]}
        if any(n == absorbed or (e == 0 and ends[n] == 2) for n, e in out):
            return frozenset({(absorbed, 0)})
        if any(e == 1 and (n == edited or n in long_stem) for n, e in out):
            return frozenset({(edited, 1)} | {(n, e) for n, e in out if e == 0})
        return frozenset((n, e) for n, e in out if not (e == 1 and (n, 0) in out))

    def move(states: frozenset, byte: int | None) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, edits in states:
            if node == absorbed:
                return states
            if node == edited:
                out.add((edited, 1))
                continue
            if byte is not None and byte in children[node]:
                out.add((children[node][byte], edits))
            if edits == 0 and far[node]:
                out.add((node, 1))
                out |= {(child, 1) for child in children[node].values() if far[child]}
        return close({(n, e) for n, e in out if e == 0 or n == edited or far[n]})

    start = close({(0, 0)})
    numbers = {frozenset(): 0, start: 1}
    order = [frozenset(), start]
    table: list[list[int]] = []

    def number(after: frozenset) -> int:
        if after not in numbers:
            numbers[after] = len(order)
            order.append(after)
        return numbers[after]

    k = 0
    while k < len(order):
        row = [number(move(order[k], None) if order[k] else order[0])] * width
        for byte in {b for n, _ in order[k] if n >= 0 for b in children[n]}:  # any other byte does what none of the alphabet does
            row[classes[byte]] = number(move(order[k], byte))
        table.append(row)
        k += 1
    exact = np.array([int(any(n == absorbed or (e == 0 and ends[n]) for n, e in s)) for s in order], dtype=np.int8)
    fuzzy = np.array([int(any(e == 1 and (n == edited or n in long_end) for n, e in s)) for s in order], dtype=np.int8) & (1 - exact)
    longest = 10**9 if stems else max([len(t) for t, _ in entries], default=0) + 1
    return Automaton(classes, np.array(table, dtype=np.int32).reshape(-1), exact, fuzzy, longest, width)


def run(automaton: Automaton, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact, fuzzy) flags of each word; words leave as soon as no entry can be reached."""
    length = ends - starts
    final = np.zeros(len(starts), dtype=np.int32)
    active = np.flatnonzero(length <= automaton.longest)
    state = np.ones(len(active), dtype=np.int32)
    place = 0
    coded = automaton.classes[low]
    while len(active):
        state = automaton.step[state * automaton.width + coded[starts[active] + place]]
        place += 1
        done = length[active] == place
        final[active[done]] = state[done]
        stay = (state > 0) & ~done
        active, state = active[stay], state[stay]
    return automaton.exact[final] > 0, automaton.fuzzy[final] > 0


def build_automata(words: list[str], stems: list[str], size: int = ENTRIES) -> list[Automaton]:
    """Automata over at most ``size`` entries each, neighbours in the alphabet together, with edits for all of MIN_FUZZY bytes or more."""
    entries = sorted([(w, False) for w in words] + [(s, True) for s in stems])
    parts = [entries[i : i + size] for i in range(0, len(entries), size)]
    return [build_automaton([t for t, stem in part if not stem], [t for t, stem in part if stem], fuzzy_stems=True) for part in parts]


@dataclass
class Matcher:
    """Automata of all entries and the hashes, sorted, of the misspellings that they match but training does not bear out."""

    automata: list[Automaton]
    blocked: np.ndarray

    def hits(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exact, fuzzy) flags of each word."""
        exact, fuzzy = np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool)
        for automaton in self.automata:
            e, f = run(automaton, low, starts, ends)
            exact |= e
            fuzzy |= f
        fuzzy &= ~exact
        at = np.flatnonzero(fuzzy)
        if len(at) and len(self.blocked):
            fuzzy[at] = ~np.isin(tb.span_hash(tb.prefix_hash(low), starts[at], ends[at]), self.blocked)
        return exact, fuzzy


def refuted(texts: DataFrame, matcher: Matcher) -> np.ndarray:
    """Sorted hashes of the misspellings whose precision among (text, label) rows is below MIN_PRECISION; distinct texts count once."""
    shared = texts.sparkSession.sparkContext.broadcast(matcher)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(1)):
                low = tb.LOWER[data]
                starts, ends, first = tb.words(low, offsets, MEMBER)
                if not len(starts):
                    continue
                at = np.flatnonzero(shared.value.hits(low, starts, ends)[1])
                pairs = np.unique(np.column_stack([np.searchsorted(first, at, "right").astype(np.uint64) - np.uint64(1), tb.span_hash(tb.prefix_hash(low), starts[at], ends[at])]), axis=0)
                label = batch.column(0).slice(row, end - row).take(pa.array(pairs[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([label, pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], names=["label", "h"])

    base = texts.filter("text is not null").select(F.col("label").cast("int").alias("label"), "text").distinct()
    kinds = base.mapInArrow(found, "label int, h long").groupBy("h").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    lost = kinds.filter(F.col("t") < MIN_PRECISION * F.col("n")).select("h").collect()
    shared.destroy()
    return np.sort(np.array([r.h for r in lost], dtype=np.int64).view(np.uint64))


def quote_places(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes where a quotation mark ends."""
    out = data == 0x22
    for mark in QUOTES:
        code = mark.encode()
        where = np.flatnonzero(data == code[-1])
        where = where[where >= len(code) - 1]
        for j in range(1, len(code)):
            where = where[data[where - j] == code[-1 - j]]
        out[where] = True
    return out


def features(matcher: Matcher, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: logs of hits outside and inside quotation, of fuzzy hits in each, densest window, hits a word, no words.

    A fuzzy hit counts as FUZZY_TRUST of a hit; its own columns let training move away from that.
    """
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, MEMBER)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    words = np.diff(first)
    out[:, 6] = words == 0
    if not len(starts):
        return out
    exact, fuzzy = matcher.hits(low, starts, ends)
    at = np.flatnonzero(exact | fuzzy)
    if not len(at):
        return out
    doc = np.searchsorted(first, at, "right") - 1
    marks = np.concatenate([[0], np.cumsum(quote_places(data))])
    before = marks[starts[at]] - marks[offsets[doc]]
    after = marks[offsets[doc + 1]] - marks[ends[at]]
    quoted = (before % 2 == 1) & (after > 0)
    trust = np.where(exact[at], 1.0, FUZZY_TRUST)
    for column, chosen in enumerate((~quoted, quoted)):
        out[:, column] = np.log1p(np.bincount(doc[chosen], weights=trust[chosen], minlength=n))
    for column, chosen in enumerate((fuzzy[at] & ~quoted, fuzzy[at] & quoted), 2):
        out[:, column] = np.log1p(np.bincount(doc[chosen], minlength=n))
    weight = trust * np.where(quoted, 0.5, 1.0)
    total = np.concatenate([[0.0], np.cumsum(weight)])
    key = at + doc * np.int64(4 * CONTEXT)  # windows of two texts never meet
    near = total[np.searchsorted(key, key + CONTEXT, "right")] - total[np.searchsorted(key, key - CONTEXT, "left")]
    np.maximum.at(out[:, 4], doc, near)
    out[:, 4] = np.log1p(out[:, 4])
    out[:, 5] = np.minimum(1.0, 20 * np.bincount(doc, weights=weight, minlength=n) / np.maximum(1, words))
    return out


@dataclass
class Model:
    matcher: Matcher
    weights: np.ndarray
    bias: float
    base_rate: float
    words: list[str]
    stems: list[str]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on the weights, not on the bias."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ beta
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + penalty
        move = np.linalg.solve(hessian, gradient)
        beta += move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def featured(rows: DataFrame, matcher: Matcher) -> list:
    """The rows' label and features, of a bounded number of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(matcher)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(1)):
                x = features(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])
        tb.trim()

    out = rows.select("label", "text").mapInArrow(compute, "label int, x array<double>").collect()
    shared.destroy()
    return out


def train(labelled: DataFrame) -> Model:
    """Fits on (doc_id, text, label) rows, which labelled_rows() bounds.

    The lexicon is learned on two thirds of the sample and the weights on the rest, so
    that the weights are not those of entries seen while they were chosen.
    """
    sample = (labelled.filter("label is not null and doc_id is not null")
              .select("text", F.col("label").cast("int").alias("label"), F.xxhash64(F.col("doc_id").cast("string")).alias("__h"))).persist()
    try:
        row = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
        rate = row.t / row.n if row.n else 0.0
        learning = sample.filter("pmod(__h, 3) > 0")
        words, stems = learned_terms(learning)
        matcher = Matcher(build_automata(words, stems), np.zeros(0, dtype=np.uint64))
        if row.t in (0, row.n) or not (words or stems):
            return Model(matcher, np.zeros(FEATURES), float("nan"), rate, words, stems)
        matcher.blocked = refuted(learning, matcher)
        fitted = featured(sample.filter("pmod(__h, 3) = 0"), matcher)
    finally:
        sample.unpersist()
    if len({r.label for r in fitted}) < 2:
        return Model(matcher, np.zeros(FEATURES), float("nan"), rate, words, stems)
    x, y = np.array([r.x for r in fitted]), np.array([r.label for r in fitted], dtype=float)
    weights, bias = logistic(x, y)
    return Model(matcher, weights, bias, rate, words, stems)


def scores(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text."""
    if np.isnan(m.bias):
        return np.full(len(offsets) - 1, m.base_rate)
    return 1 / (1 + np.exp(-np.clip(features(m.matcher, data, offsets) @ m.weights + m.bias, -30, 30)))


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted for every document; reads nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    names = [f.name for f in fields]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(batch.schema.get_field_index("__text"))):
                score = scores(m, data, offsets)
                head = [batch.column(batch.schema.get_field_index(c)).slice(row, end - row) for c in names]
                yield pa.RecordBatch.from_arrays([*head, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(judge, f"{types}, score double, predicted int")


def fold(column: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def labelled_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most sample_rows labels of the training folds, the smallest by a hash of doc_id.

    The labels are chosen before any text is read, and are few enough to broadcast.
    """
    known = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("toxic").alias("label")).filter(fold("__id") != 0)
    chosen = known.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id", "label").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = shared.value
        return lambda data, offsets: scores(model, data, offsets) < threshold

    return keep_rows(docs, prepare, shared)
