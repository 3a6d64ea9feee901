"""Improbable-feature digests: rare byte windows in chained Bloom filters.

A candidate feature is the window of WINDOW bytes at each byte. Its entropy over bytes, in
thousandths of the most possible, is ranked by rarity: the fewer windows of the whole
corpus have that entropy, the more improbable it is. A window is selected when it is the
most improbable of at least VOTES of the NEIGHBOURS-long runs of candidates around it
(all candidates of a text with fewer); among equal ranks a hash of the window decides, and
a window that wins a run and recurs in the next NEIGHBOURS - 1 places, as in text with a
short period, needs no more votes. If none is selected, the winners of all runs are.
Selected windows are hashed and set HASHES bits
each in filters of 2,048 bits; a filter takes FILL distinct features and the next one
chains on. Likeness is the overlap of set bits between the filters of the shorter chain
and their best partners, normalised between what chance gives and the most possible.

The digest's first field is the number of features, then the filters follow in
base64. The only thing that reaches the driver is the table of counts by entropy, which
has 1,001 entries at any input size.

Defined cases: null and empty texts have no feature, and their digests equal each
other and nothing else (likeness 1 and 0); a text with no window of full length is one
feature; texts of any length are read whole; repeated rows are digested each, in the order of
doc_id and text; null doc_ids come first, and ids that are no integers go in the order of their type; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import shuffle_partitions, written

WINDOW = 64
NEIGHBOURS = 16
VOTES = 6
HASHES = 5
BITS = 2048
FILL = 160
LEVELS = 1001
#: Windows below this entropy (thousandths) are runs and padding: never preferred to others.
LEAST = 100
#: Share of the way from chance to the most possible overlap that still counts as 0.
CUT = 0.3

#: c log2 c of every count in 2**-32, and what the c-th equal byte adds to it.
_C = np.arange(WINDOW + 1, dtype=np.float64)
COUNT_SUM = np.rint(2.0**32 * _C * np.log2(np.maximum(_C, 1))).astype(np.int64)
COUNT_STEP = np.diff(COUNT_SUM, prepend=0)
#: Windows whose counts are made at a time, few enough for the processor's cache.
BLOCK = 1 << 16


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of data[s : s + WINDOW), in thousandths of log2(WINDOW), for every s.

    A step to the next window takes out one byte and puts in one, so the sum of c log c
    changes by what the counts of these two bytes say; the counts come from comparisons of
    the data with itself moved by 1 to WINDOW - 1. Sums are integers: a window's level does
    not depend on where it stands.
    """
    n = max(0, len(data) - WINDOW + 1)
    out = np.zeros(n, dtype=np.int16)
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK + WINDOW - 1]
        size = len(part)
        ahead, behind = np.ones(size, dtype=np.uint8), np.ones(size, dtype=np.uint8)
        same = np.empty(size, dtype=bool)
        for j in range(1, WINDOW):
            equal = np.equal(part[:-j], part[j:], out=same[: size - j]).view(np.uint8)
            ahead[:-j] += equal
            behind[j:] += equal
        sums = np.empty(size - WINDOW + 1, dtype=np.int64)
        sums[0] = COUNT_SUM[np.bincount(part[:WINDOW])].sum()
        sums[1:] = COUNT_STEP[behind[WINDOW:]] - COUNT_STEP[ahead[: size - WINDOW]]
        np.cumsum(sums, out=sums)
        out[at : at + len(sums)] = np.rint(1000 - sums * (1000 / COUNT_SUM[WINDOW]))
    return out


def window_entropy(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Entropy of data[s : s + WINDOW), in thousandths of log2(WINDOW)."""
    return entropy_levels(data)[starts]


def candidates(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the full windows at every byte, and each text's first among them."""
    sizes = np.maximum(0, np.diff(offsets) - WINDOW + 1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], sizes), first


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least key (the first of equals) of every run of ``width`` keys."""
    n = len(keys) - width + 1
    tagged = (keys.astype(np.uint64) << np.uint64(40)) | np.arange(len(keys), dtype=np.uint64)
    pad = -len(keys) % width
    blocks = np.append(tagged, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    return (least & np.uint64((1 << 40) - 1)).astype(np.int64)


def selected(rank: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which candidates win enough runs within their own text; equal ranks are told apart by the windows' hashes."""
    sizes = np.diff(first)
    chosen = np.repeat(sizes < NEIGHBOURS, sizes)
    if len(rank) >= NEIGHBOURS:
        winner = sliding_argmin((rank << 14) | (hashes >> np.uint64(50)).astype(np.int64), NEIGHBOURS)
        text = np.repeat(np.arange(len(sizes)), sizes)
        whole = text[: len(winner)] == text[NEIGHBOURS - 1 :]
        votes = np.bincount(winner[whole], minlength=len(rank))
        chosen |= votes >= VOTES
        few = (votes > 0) & (votes < VOTES)
        for d in range(1, NEIGHBOURS):
            again = np.flatnonzero(hashes[:-d] == hashes[d:])
            chosen[again[few[again] & (text[again] == text[again + d])]] = True
        kept = np.concatenate([[0], np.cumsum(chosen)])
        bare = kept[first[1:]] == kept[first[:-1]]
        chosen |= few & np.repeat(bare, sizes)
    return chosen


def feature_lists(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows in order, and each text's first among them."""
    starts, first = candidates(offsets)
    prefix = tb.prefix_hash(data)
    hashes = tb.span_hash(prefix, starts, starts + WINDOW)
    keep = selected(rarity[window_entropy(data, starts)], hashes, first)
    starts, hashes = starts[keep], hashes[keep]
    lone = (np.diff(first) == 0) & (np.diff(offsets) > 0)
    begin = np.concatenate([starts, offsets[:-1][lone]])
    hashes = np.concatenate([hashes, tb.span_hash(prefix, offsets[:-1][lone], offsets[1:][lone])])
    order = np.argsort(begin, kind="stable")
    return hashes[order], np.searchsorted(begin[order], offsets)


class Digest:
    """Number of features and the chain of filters, as 64-bit words."""

    __slots__ = ("count", "words")

    def __init__(self, features: np.ndarray) -> None:
        kinds, at = np.unique(features, return_index=True)
        kinds = kinds[np.argsort(at)]
        self.count = len(kinds)
        filters = -(-len(kinds) // FILL)
        bits = np.zeros(filters * BITS, dtype=np.uint8)
        base = np.arange(len(kinds)) // FILL * BITS
        for j in range(HASHES):
            bits[base + ((kinds >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64).reshape(filters, BITS // 64)

    def text(self) -> str:
        return f"{self.count}:{base64.b64encode(self.words.tobytes()).decode()}"

    def sizes(self) -> np.ndarray:
        out = np.full(len(self.words), FILL)
        if len(out):
            out[-1] = self.count - FILL * (len(out) - 1)
        return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1; 1 for equal digests."""
    if a.count == b.count and np.array_equal(a.words, b.words):
        return 1.0
    if not a.count or not b.count:
        return 0.0
    if len(a.words) > len(b.words):
        a, b = b, a
    overlap = np.bitwise_count(a.words[:, None, :] & b.words[None, :, :]).sum(axis=2).astype(float) if len(a.words) * len(b.words) <= 4096 else np.stack([np.bitwise_count(w & b.words).sum(axis=1) for w in a.words]).astype(float)
    most = np.minimum(np.bitwise_count(a.words).sum(axis=1)[:, None], np.bitwise_count(b.words).sum(axis=1)[None, :])
    stay = (1 - 1 / BITS) ** HASHES
    sa, sb = a.sizes()[:, None], b.sizes()[None, :]
    chance = BITS * (1 - stay**sa - stay**sb + stay ** (sa + sb))
    least = chance + CUT * (most - chance)
    part = np.where(most > least, np.clip((overlap - least) / np.maximum(most - least, 1e-9), 0, 1), 0.0)
    return float(np.average(part.max(axis=1), weights=a.sizes()))


def rarity_table(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy level, 0 the rarest among all windows of all texts; levels never seen rank by distance from the common ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column(0), 1 << 20):
                starts, _ = candidates(offsets)
                sums += np.bincount(window_entropy(data, starts), minlength=LEVELS)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], names=["level", "n"])

    total = np.zeros(LEVELS, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        total[r.level] = r.n
    low = np.arange(LEVELS) < LEAST
    order = np.lexsort([np.arange(LEVELS), total, low])
    out = np.empty(LEVELS, dtype=np.int64)
    out[order] = np.arange(LEVELS)
    return out


def digests(texts: list[str], rarity: np.ndarray) -> list[Digest]:
    out: list[Digest] = []
    for _, end, data, offsets in tb.slices(pa.array(texts, pa.large_string()), 1 << 20):
        features, first = feature_lists(data, offsets, rarity)
        out += [Digest(features[first[i] : first[i + 1]]) for i in range(len(offsets) - 1)]
    return out


def fingerprint(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """doc_id and fingerprint of every document; shuffles nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(1), 1 << 20):
                features, first = feature_lists(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([Digest(features[first[i] : first[i + 1]]).text() for i in range(end - row)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (__b, __kind, __k, doc_id, text), partitioned by __b and sorted, in which each row's next document follows it.

    doc_ids are dealt to ranges by approximate quantiles; the first document of each
    range also goes, as kind 1, to the end of the range before it (the first range's to
    the last). Texts are shuffled once and no task holds more than a stream of its range.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        keyed = rows.withColumn("__k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    else:  # ids of another type are numbered in their order
        numbers = written(rows.select("doc_id").distinct().orderBy(F.asc_nulls_first("doc_id")).withColumn("__k", F.monotonically_increasing_id()), "fingerprint-ids")
        keyed = rows.join(numbers.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "__k")
    ids = keyed.select(F.col("__k").cast("double").alias("k"))
    splits = sorted(set(ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    array = "array(" + ",".join(f"{x!r}D" for x in splits) + ")" if splits else "cast(array() as array<double>)"
    dealt = keyed.withColumn("__b", F.expr(f"size(filter({array}, x -> x <= cast(__k as double)))"))
    heads = sorted((r["__b"], r["k"]) for r in dealt.select("__b", "__k").groupBy("__b").agg(F.min("__k").alias("k")).collect())
    goes = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    ahead = dealt.filter(F.col("__k").isin([k for k, _ in goes])) if goes else dealt.limit(0)
    moved = F.create_map(*[F.lit(x) for pair in goes for x in pair])[F.col("__k")] if goes else F.col("__b")
    both = dealt.withColumn("__kind", F.lit(0)).unionByName(ahead.withColumn("__b", moved).withColumn("__kind", F.lit(1)))
    return both.select("__b", "__kind", "__k", "doc_id", "text").repartition(parts, "__b").sortWithinPartitions("__b", "__kind", "__k", "text")


def edited_fingerprints(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Fingerprints of every text and its edited text (its last half replaced by the next document's beginning), and likenesses."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for b, ahead, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if last is not None and last[0] == b:
                    group.append((last[1], last[2], text))
                    size += len(last[2])
                    if size > 1 << 19:
                        yield finish(group)
                        group, size = [], 0
                last = None if ahead else (b, doc_id, text)
        if group:
            yield finish(group)

    def finish(group: list[tuple]) -> pa.RecordBatch:
        texts, following = [g[1] for g in group], [g[2] for g in group]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
        own, other = digests(texts, shared.value), digests(edited, shared.value)
        # a row's next document is mostly the row after it, so only the others are digested again
        fresh = [i for i in range(len(group)) if i + 1 == len(group) or following[i] != texts[i + 1]]
        after = [*own[1:], own[0]]
        for i, digest in zip(fresh, digests([following[i] for i in fresh], shared.value), strict=True):
            after[i] = digest
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in group]).cast(arrow_id), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
             pa.array([d.text() for d in own], pa.string()), pa.array([d.text() for d in other], pa.string()),
             pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    return with_next(docs).mapInArrow(make, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
