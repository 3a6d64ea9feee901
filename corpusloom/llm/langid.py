"""Language identification by rank-order profiles.

Texts are lower-cased; letters make words and anything else separates them. A text's
n-grams of 1 to 3 letters, with one blank before and after each word for those of 2 and 3,
are counted over the whole text; its PROFILE most frequent ones, in order of count and then
of their code points, are its rank-order profile. The distance to a language is the
out-of-place sum: for each n-gram the difference of its ranks, or the profile's length if
the language's profile lacks it. The nearest language wins; equal distances go to the first
in sorted order. The score is 1 - nearest / second nearest distance (1 if only one is known
and nearest is 0, else 1 - nearest / worst).

An n-gram's key is its code points of 21 bits each, NONE after the last of a shorter one: 63
bits, exact for every script and every plane.

Bounds: a language profile is learned from at most TRAIN_ROWS texts (the smallest by a
hash of doc_id), with all their n-grams; one row a language, its count or its profile, is
all that reaches the driver.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every
text when nothing could be learned; null lang is not learned from; repeated rows are
judged one by one; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb

PROFILE = 300
TRAIN_ROWS = 1500
#: Of a language's rows so many times TRAIN_ROWS are looked at on average before the smallest hashes are taken.
SPARE = 4
BITS = 21
NONE = (1 << BITS) - 1

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points of all planes are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(code).isalpha() for code in range(0x110000)]))
    return _LETTERS[0]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, 0 for what is no letter; a 0 stands before each text and after the last. And where each begins."""
    low = [" " + t.lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    points = np.frombuffer(("".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(letter_table()[points], points, np.uint32(0)), offsets


def local_grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row * kinds**3 + gram of local letters) for every n-gram, the local letters in order (the first is the blank, after the last comes NONE), kinds."""
    letters, local = np.unique(points, return_inverse=True)
    if not len(letters) or letters[0] != 0:
        raise ValueError("a blank stands before each text")
    kinds = len(letters) + 1
    none = np.uint64(kinds - 1)
    c = local.reshape(-1).astype(np.uint64)
    n = len(points) - 1
    a, b = c[:n], c[1 : n + 1].copy()
    third = np.append(c[2:], np.uint64(0))
    last = np.zeros(n, dtype=bool)
    last[offsets[1:] - 1] = True
    b[last] = 0
    third[last | np.append(last[1:], True)] = 0
    k = np.uint64(kinds)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets)) * (k * k * k)
    one, two, three = a > 0, (a > 0) | (b > 0), b > 0
    keys = [row[one] + (a[one] * k + none) * k + none, row[two] + (a[two] * k + b[two]) * k + none, row[three] + (a[three] * k + b[three]) * k + third[three]]
    return np.concatenate(keys), letters, kinds


def code_of(gram: np.ndarray, letters: np.ndarray, kinds: int) -> np.ndarray:
    """The 63-bit keys of grams of local letters, as signed integers; the order stays."""
    points = np.append(letters.astype(np.int64), NONE)
    gram = gram.astype(np.int64)
    return points[gram // (kinds * kinds)] << (2 * BITS) | points[gram // kinds % kinds] << BITS | points[gram % kinds]


def gram_text(code: int) -> str:
    """The n-gram of a key, a blank where a word begins or ends."""
    return "".join(chr(p) if p else " " for p in (code >> 2 * BITS, code >> BITS & NONE, code & NONE) if p != NONE)


def gram_code(gram: str) -> int:
    points = [0 if c == " " else ord(c) for c in gram] + [NONE] * (3 - len(gram))
    return points[0] << 2 * BITS | points[1] << BITS | points[2]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[fresh], np.diff(np.append(fresh, len(keys)))


def gram_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows from there, key, count) of the texts' n-grams, for runs of rows; in order of row and key."""
    points, offsets = coded(texts)
    kinds = len(np.unique(points)) + 2
    if len(texts) > 1 and kinds**3 * len(texts) >= 1 << 63:
        half = len(texts) // 2
        yield from gram_counts(texts[:half])
        for begin, row, code, count in gram_counts(texts[half:]):
            yield begin + half, row, code, count
        return
    keys, letters, kinds = local_grams(points, offsets)
    keys, counts = counted(keys)
    cube = np.uint64(kinds**3)
    yield 0, (keys // cube).astype(np.int64), code_of(keys % cube, letters, kinds), counts


def ranked(texts: list[str], size: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank) of each text's profile, and which texts have a letter."""
    found = []
    letters = np.zeros(len(texts), dtype=bool)
    for begin, row, gram, counts in gram_counts(texts):
        order = np.argsort(row * (1 << 40) - counts, kind="stable")  # the keys are in order already
        row, gram = row[order], gram[order]
        first = np.searchsorted(row, row)
        rank = np.arange(len(row)) - first
        letters[begin + row] = True
        keep = rank < size
        found.append((begin + row[keep], gram[keep], rank[keep]))
    return (*(np.concatenate([f[i] for f in found]) for i in range(3)), letters)


def parts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, len(texts)


def learn(labelled: DataFrame, size: int = PROFILE, train_rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """Language to its profile, the n-grams in order of rank, from (doc_id, text, lang) rows."""
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null")
    marked = rows.select("lang", F.col("doc_id").alias("__id"), F.xxhash64(F.col("doc_id").cast("string")).alias("__h"))
    sizes = marked.groupBy("lang").agg(F.count("*").alias("__rows"))  # one row a language, as the profiles have
    share = F.lit(2.0**64) * SPARE * train_rows / F.col("__rows") - F.lit(2.0**63)
    few = marked.join(F.broadcast(sizes), "lang").filter(F.col("__h").cast("double") <= share)
    nearest = Window.partitionBy("lang").orderBy("__h", "__id")
    chosen = few.withColumn("__n", F.row_number().over(nearest)).filter(F.col("__n") <= train_rows).select(F.col("lang").alias("__lang"), "__id")
    # train_rows rows a language are few enough to broadcast
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in parts(texts):
                names = sorted(set(langs[start:end]))
                number = np.array([names.index(x) for x in langs[start:end]])
                for begin, row, gram, counts in gram_counts(texts[start:end]):
                    order = np.lexsort([gram, number[begin + row]])
                    lang, gram, counts = number[begin + row][order], gram[order], counts[order]
                    fresh = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
                    if len(fresh):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[k] for k in lang[fresh].tolist()], pa.string()), pa.array(gram[fresh], pa.int64()), pa.array(np.add.reduceat(counts, fresh), pa.int64())],
                            names=["lang", "gram", "n"])

    sums = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)
    out: dict[str, list[str]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(gram_text(r.gram))
    return out


def rank_table(profiles: dict[str, list[str]], size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the keys of all their n-grams in order, and their ranks by language and key (``size`` where absent, as in the last column, for any other key)."""
    names = sorted(profiles)
    codes = np.unique(np.array([gram_code(g) for name in names for g in profiles[name]], dtype=np.int64))
    ranks = np.full((len(names), len(codes) + 1), size, dtype=np.int64)
    for k, name in enumerate(names):
        ranks[k, np.searchsorted(codes, np.array([gram_code(g) for g in profiles[name]], dtype=np.int64))] = np.arange(len(profiles[name]))
    return names, codes, ranks


def judge(texts: list[str], table: tuple[list[str], np.ndarray, np.ndarray], size: int = PROFILE) -> tuple[list[str], np.ndarray]:
    names, codes, ranks = table
    row, gram, rank, letters = ranked(texts, size)
    place = np.minimum(np.searchsorted(codes, gram), len(codes) - 1)
    place = np.where(codes[place] == gram, place, len(codes))
    distance = np.zeros((len(names), len(texts)))
    for k in range(len(names)):
        known = ranks[k][place]
        apart = np.where(known == size, size, np.abs(known - rank))
        distance[k] = np.bincount(row, weights=apart, minlength=len(texts))
    best = distance.argmin(axis=0)
    least = distance[best, np.arange(len(texts))]
    if len(names) > 1:
        other = np.sort(distance, axis=0)[1]
    else:
        other = np.bincount(row, minlength=len(texts)) * float(size)
    score = np.where(other > 0, 1 - least / np.maximum(other, 1e-9), 0.0) * letters
    return [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.clip(score, 0, 1)


def identify(docs: DataFrame, profiles: dict[str, list[str]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score; reads nothing but the text and shuffles nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_table(profiles, PROFILE))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    heads = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).fill_null("")
            for row, end, _, _ in tb.slices(texts, 1 << 20):
                own = texts.slice(row, end - row).to_pylist()
                if shared.value[0]:
                    langs, score = judge(own, shared.value)
                else:
                    langs, score = ["und"] * len(own), np.zeros(len(own))
                head = [batch.column(batch.schema.get_field_index(c)).slice(row, end - row) for c in heads]
                yield pa.RecordBatch.from_arrays([*head, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*heads, "lang_pred", "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{types}, lang_pred string, score double")


def held_out(column: str = "doc_id") -> Column:
    """The fold that is not learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2
