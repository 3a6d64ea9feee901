"""Benchmark decontamination by suffix arrays of the training text.

Every slice of documents is a shard with a suffix array: its word positions in the order of
the words that follow. Positions whose first two words begin no benchmark window are left
out, which loses no match. Every benchmark suffix (cut to a window) is binary-searched in
the array; the interval found gives all its places, and words are compared byte by byte
there, as the array is ordered by their hashes. Matches that follow each other in a document
and in an item join to the longest verbatim match. Documents with a match are affected.

No document is shuffled. The benchmark is split into blocks of about BLOCK_WORDS words, made
by tasks, and one block at a time is broadcast: one block takes one pass over the documents,
more blocks take a pass each, whose hits, keyed by row, are put together afterwards.

Defined cases: null or wordless texts have no words and never match; null items
likewise; a null item_id is an empty one; an item with fewer words than the window is one window; repeated item_ids
count once; items of equal texts are one text with several names; repeated document rows are
judged one by one; texts of any length are read whole; other columns, whatever their names,
pass through ``remove_contaminated`` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import keep_rows, release, written

WINDOW = 10
#: Words of a broadcast block, about; an item is never cut, so a longer one is a block of its own size.
BLOCK_WORDS = 250_000
#: Uses of windows that are put together to longest matches at a time.
USES = 1 << 21

MEMBER = np.zeros(256, dtype=bool)
MEMBER[0x30:0x3A] = True
MEMBER[0x61:0x7B] = True
MEMBER[0x80:] = True


@dataclass
class Words:
    """Lower-cased bytes, the words' hashes and spans, and each text's first word."""

    low: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, MEMBER)
    return Words(low, tb.span_hash(tb.prefix_hash(low), starts, ends), starts, ends, first)


def pair_hash(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the two words from each place."""
    return tb.mix(hashes[at] * np.uint64(tb.BASE) + hashes[at + 1])


@dataclass
class Block:
    """Distinct windows (by their words) of the block's texts: word place, number of words, and the texts that hold each.

    ``first`` delimits a window's uses: use u is the window at word ``place[u]`` of text ``item[u]``; a window's uses are
    in order of text. ``names`` has the item_ids of each text. ``group`` numbers the sets of texts, ``members`` lists them.
    """

    words: Words
    at: np.ndarray
    need: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    names: list[list[str]]
    group: np.ndarray
    members: list[np.ndarray]

    def begins(self) -> np.ndarray:
        """Hash of each window's first two words, or of its only one."""
        out = self.words.hashes[self.at].copy()
        long = self.need > 1
        out[long] = pair_hash(self.words.hashes, self.at[long])
        return out


def make_block(ids: list, texts: list, window: int = WINDOW) -> Block:
    named: dict[str, set[str]] = {}
    for item_id, text in zip(ids, texts, strict=True):
        if text is not None:
            named.setdefault(text, set()).add("" if item_id is None else str(item_id))
    kinds = sorted(named)
    raw = [t.encode() for t in kinds]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    words = words_of(data, np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
    low = words.low.tobytes()
    token = [low[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
    seen: dict[bytes, list[tuple[int, int]]] = {}
    spot: list[int] = []
    need: list[int] = []
    for text in range(len(kinds)):
        begin, end = int(words.first[text]), int(words.first[text + 1])
        n = min(window, end - begin)
        for k in range(begin, end - n + 1 if n else begin):
            key = b" ".join(token[k : k + n])
            uses = seen.get(key)
            if uses is None:
                uses = seen[key] = []
                spot.append(k)
                need.append(n)
            uses.append((text, k - begin))
    uses = list(seen.values())
    sets: dict[tuple, int] = {}
    group = [sets.setdefault(tuple(sorted({t for t, _ in u})), len(sets)) for u in uses]
    flat = [x for u in uses for x in u]
    return Block(words, np.array(spot, np.int64), np.array(need, np.int64), np.concatenate([[0], np.cumsum([len(u) for u in uses])]).astype(np.int64),
                 np.array([t for t, _ in flat], np.int64), np.array([p for _, p in flat], np.int64), [sorted(named[t]) for t in kinds],
                 np.array(group, np.int64), [np.array(x, np.int64) for x in sets])


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[int]]:
    """Written (block, data) rows with a pickled Block each, made by tasks, and the blocks' numbers; equal texts are in one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.floor(F.length("text") / 3) + 1).alias("n")).first().n or 0
    count = max(1, -(-int(size) // block_words))

    def make(table: pa.Table) -> pa.Table:
        block = make_block(table.column("item_id").to_pylist(), table.column("text").to_pylist(), window)
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([pickle.dumps(block)], pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)).cast("int"))
    blocks = written(dealt.groupBy("block").applyInArrow(make, "block int, data binary"), "benchmark-blocks")
    return blocks, sorted(r.block for r in blocks.select("block").collect())


def compare(shard: np.ndarray, test: np.ndarray, need: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each pair of rows, over the first ``need`` words."""
    differ = (shard != test) & (np.arange(test.shape[1])[None, :] < need[:, None])
    at = differ.argmax(axis=1)
    rows = np.arange(len(test))
    return np.where(differ[rows, at], np.where(shard[rows, at] < test[rows, at], -1, 1), 0)


def bound(shard: np.ndarray, test: np.ndarray, need: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of every test row in the sorted shard rows."""
    low, high = np.zeros(len(test), np.int64), np.full(len(test), len(shard))
    while (active := np.flatnonzero(low < high)).size:
        mid = (low[active] + high[active]) // 2
        side = compare(shard[mid], test[active], need[active])
        right = side <= 0 if upper else side < 0
        low[active[right]] = mid[right] + 1
        high[active[~right]] = mid[~right]
    return low


def following(hashes: np.ndarray, at: np.ndarray, room: np.ndarray, window: int) -> np.ndarray:
    """The ``window`` word hashes from each place, 0 beyond the text's end."""
    out = np.zeros((len(at), window), dtype=np.uint64)
    for j in range(window):
        ok = room > j
        out[ok, j] = hashes[at[ok] + j]
    return out


def suffix_array(words: Words, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places, in the order of the words from there on, those words, and the hash of the first two (or the one that begins a window alone).

    ``begins`` has the sorted hashes of how windows begin.
    """
    hashes, first = words.hashes, words.first
    n = len(hashes)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    sieve = np.zeros(1 << 20, dtype=bool)
    sieve[(begins & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def known(h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return maybe[begins[np.minimum(np.searchsorted(begins, h[maybe]), len(begins) - 1)] == h[maybe]]

    one = known(hashes)
    long = np.flatnonzero(room > 1)
    two = long[known(pair_hash(hashes, long))]
    at = np.union1d(one, two)
    table = following(hashes, at, room[at], window)
    order = np.lexsort(table.T[::-1])
    at, table = at[order], table[order]
    own = np.concatenate([hashes[one], pair_hash(hashes, two)])
    return at, table, np.unique(own)


def same_words(a: Words, at: np.ndarray, b: Words, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from ``at`` of a and from ``place`` of b are equal byte by byte."""
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.repeat(at, n) + inside, np.repeat(place, n) + inside
    size = a.ends[i] - a.starts[i]
    ok = size == b.ends[j] - b.starts[j]
    size = np.where(ok, size, 0)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wrong = np.concatenate([[0], np.cumsum(a.low[np.repeat(a.starts[i], size) + step] != b.low[np.repeat(b.starts[j], size) + step])])
    ok &= wrong[np.cumsum(size)] == wrong[np.cumsum(size) - size]
    bad = np.concatenate([[0], np.cumsum(~ok)])
    return bad[np.cumsum(n)] == bad[np.cumsum(n) - n]


def search(block: Block, begins: np.ndarray, words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, word place) of every match of a benchmark window in the shard."""
    none = np.zeros(0, np.int64)
    if not len(block.at) or not len(words.hashes):
        return none, none
    array, table, own = suffix_array(words, np.unique(begins), window)
    if not len(array):
        return none, none
    asked = np.flatnonzero(own[np.minimum(np.searchsorted(own, begins), len(own) - 1)] == begins)
    room = np.full(len(asked), window)
    test = following(block.words.hashes, block.at[asked], np.minimum(room, block.need[asked]), window)
    low = bound(table, test, block.need[asked], False)
    high = bound(table, test, block.need[asked], True)
    count = high - low
    tests = np.repeat(asked, count)
    at = array[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    last = words.first[np.searchsorted(words.first, at, "right")]
    fits = at + block.need[tests] <= last
    tests, at = tests[fits], at[fits]
    good = [same_words(words, at[i : i + 65536], block.words, block.at[tests[i : i + 65536]], block.need[tests[i : i + 65536]]) for i in range(0, len(at), 65536)]
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return tests[keep], at[keep]


def longest_matches(block: Block, words: Words, test: np.ndarray, at: np.ndarray, low: int = 0, high: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, text, word of the text, word of the shard, length) of the matches that cannot be continued, for texts low to high."""
    texts = len(block.names)
    high = texts if high is None else high
    window = np.repeat(np.arange(len(block.at)), np.diff(block.first))
    key = window * texts + block.item  # in order
    begin, end = np.searchsorted(key, test * texts + low), np.searchsorted(key, test * texts + high)
    uses = end - begin
    if uses.sum() > USES and high - low > 1:
        middle = (low + high) // 2
        yield from longest_matches(block, words, test, at, low, middle)
        yield from longest_matches(block, words, test, at, middle, high)
        return
    if not uses.sum():
        return
    use = np.repeat(begin, uses) + np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
    test, at = np.repeat(test, uses), np.repeat(at, uses)
    doc = np.searchsorted(words.first, at, "right") - 1
    item, place = block.item[use], block.place[use]
    shift = at - place
    order = np.lexsort([at, shift, item, doc])
    doc, item, shift, at, test, place = doc[order], item[order], shift[order], at[order], test[order], place[order]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(at) != 1)
    head = np.flatnonzero(fresh)
    length = np.diff(np.append(head, len(at))) - 1 + block.need[test[head]]
    yield doc[head], item[head], place[head], at[head], length


@dataclass
class Found:
    """Of a shard's documents: which words are hit, the item_ids met, and the longest match."""

    words: Words
    hit: np.ndarray
    items: list[set]
    longest: np.ndarray


def judged(block: Block, begins: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int) -> Found:
    words = words_of(data, offsets)
    rows = len(offsets) - 1
    found = Found(words, np.zeros(len(words.hashes), dtype=bool), [set() for _ in range(rows)], np.zeros(rows, np.int64))
    test, at = search(block, begins, words, window)
    if len(test):
        size = len(words.hashes) + 1
        delta = np.bincount(at, minlength=size) - np.bincount(at + block.need[test], minlength=size)
        found.hit = np.cumsum(delta[:-1]) > 0
        doc = np.searchsorted(words.first, at, "right") - 1
        width = len(block.members)
        for pair in np.unique(doc * width + block.group[test]).tolist():
            found.items[pair // width].update(name for t in block.members[pair % width].tolist() for name in block.names[t])
        for doc, _, _, _, length in longest_matches(block, words, test, at):
            np.maximum.at(found.longest, doc, length)
    return found


def pass_over(docs: DataFrame, block: DataFrame | None, work: Callable, schema: str, window: int) -> DataFrame:
    """work(block, begins, batches) over the documents with the one block broadcast; an empty block where there is none."""
    data = block.first().data if block is not None else pickle.dumps(make_block([], [], window))
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(shared.value)
        yield from work(held, held.begins(), batches)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` columns with n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest match) and item_ids for each document."""
    blocks, numbers = blocks_of(benchmark, window, block_words)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))
    heads = [f for f in plain.schema.fields if f.name != "__text"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in heads)
    tail = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, item_ids array<string>"
    names = [f.name for f in heads]

    def whole(block: Block, begins: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(batch.num_columns - 1), 1 << 20):
                found = judged(block, begins, data, offsets, window)
                hit = np.concatenate([[0], np.cumsum(found.hit)])
                n_hit = hit[found.words.first[1:]] - hit[found.words.first[:-1]]
                yield report([batch.column(i).slice(row, end - row) for i in range(len(names))], names, np.diff(found.words.first), n_hit, [sorted(x) for x in found.items], found.longest)

    if len(numbers) <= 1:
        out = pass_over(plain, blocks.filter(F.col("block") == numbers[0]) if numbers else None, whole, f"{types}, {tail}" if types else tail, window)
        return out.toDF(*keep, *out.columns[len(keep) :])

    keyed = written(plain.withColumn("__row", F.monotonically_increasing_id()).select("__row", *plain.columns), "benchmark-rows")

    def partly(block: Block, begins: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(batch.num_columns - 1), 1 << 20):
                found = judged(block, begins, data, offsets, window)
                first = found.words.first
                lists: list[list[int]] = [[] for _ in range(end - row)]
                for i in range(end - row):  # runs of hit words, from and to, within the document
                    if found.items[i]:
                        own = found.hit[first[i] : first[i + 1]].astype(np.int8)
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
                        lists[i] = edge.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(np.diff(first), pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array([sorted(x) for x in found.items], pa.list_(pa.string())), pa.array(found.longest, pa.int64())],
                    names=["__row", "n", "runs", "items", "longest"])

    parts = []
    for number in numbers:
        part = pass_over(keyed.select("__row", "__text"), blocks.filter(F.col("block") == number), partly, "__row long, n long, runs array<long>, items array<string>, longest long", window)
        parts.append(written(part, "benchmark-hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    grouped = hits.groupBy("__row").agg(F.first("n").alias("n"), F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    joined = keyed.drop("__text").join(grouped, "__row").select(*names, "n", "runs", "items", "longest")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(names)
            runs, n = batch.column(k + 1).to_pylist(), batch.column(k).to_numpy()
            n_hit = []
            for own, size in zip(runs, n.tolist(), strict=True):
                delta = np.zeros(size + 1, dtype=np.int64)
                for one in own:
                    delta[one[0::2]] += 1
                    delta[one[1::2]] -= 1
                n_hit.append(int((np.cumsum(delta[:-1]) > 0).sum()))
            yield report([batch.column(i) for i in range(k)], names, n, np.array(n_hit, dtype=np.int64), [sorted(x) for x in batch.column(k + 2).to_pylist()], batch.column(k + 3).to_numpy())

    out = joined.mapInArrow(together, f"{types}, {tail}" if types else tail)
    return out.toDF(*keep, *out.columns[len(keep) :])


def report(heads: list, names: list[str], n_words: np.ndarray, n_hit: np.ndarray, lists: list[list[str]], longest: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*heads, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()),
         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array(n_hit > 0), pa.array(longest, pa.int64()), pa.array(lists, pa.list_(pa.string()))],
        names=[*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "item_ids"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim matches: doc_id, item_id, item_word, doc_word, n_words (words from 0)."""
    blocks, numbers = blocks_of(benchmark, window, block_words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(block: Block, begins: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in tb.slices(batch.column(1), 1 << 20):
                words = words_of(data, offsets)
                test, at = search(block, begins, words, window)
                for doc, text, place, spot, length in longest_matches(block, words, test, at):
                    times = np.array([len(block.names[t]) for t in text.tolist()])
                    name = [x for t in text.tolist() for x in block.names[t]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.repeat(row + doc, times))), pa.array(name, pa.string()), pa.array(np.repeat(place, times), pa.int64()),
                         pa.array(np.repeat(spot - words.first[doc], times), pa.int64()), pa.array(np.repeat(length, times), pa.int64())],
                        names=["doc_id", "item_id", "item_word", "doc_word", "n_words"])

    schema = f"doc_id {kind}, item_id string, item_word long, doc_word long, n_words long"
    rows = docs.select("doc_id", "text")
    found = [pass_over(rows, blocks.filter(F.col("block") == n), find, schema, window) for n in numbers] or [pass_over(rows, None, find, schema, window)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any benchmark window, with all their columns; a pass over what is left for each block."""
    blocks, numbers = blocks_of(benchmark, window, block_words)
    out, before = docs, None
    for k, number in enumerate(numbers):
        data = blocks.filter(F.col("block") == number).first().data
        shared = docs.sparkSession.sparkContext.broadcast(data)

        def clean(shared=shared) -> Callable:
            held = pickle.loads(shared.value)
            begins = held.begins()
            return lambda texts, offsets: ~hit_rows(held, begins, texts, offsets, window)

        out = keep_rows(out, clean)
        if k + 1 < len(numbers):
            out = written(out, "benchmark-left")
            if before is not None:
                release(before)
            before = out
    release(blocks)
    return out


def hit_rows(block: Block, begins: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    words = words_of(data, offsets)
    _, at = search(block, begins, words, window)
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[np.searchsorted(words.first, at, "right") - 1] = True
    return out
