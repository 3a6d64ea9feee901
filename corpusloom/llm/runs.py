"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words that repeats with its smallest period q at least twice (words
q apart are identical) and that no neighbouring word extends. Documents are rows; in a
task, a slice of texts is one string of numbered words with a symbol of its own between
texts, so runs never cross documents. On it, in arrays:

1. A suffix array with common prefixes of neighbours stands for the suffix tree: a node
   or a place on an edge is an interval of suffixes and a depth.
2. Each suffix's longest earlier factor gives the Lempel-Ziv blocks, and for each block,
   common extensions forwards and backwards of its ends give a set of squares that covers
   the leftmost occurrence of every one.
3. From each square's end in the tree the walk goes along suffix links: without its first
   word a square is again one, turned by a word, if that word can follow. Inside
   the run of a square all turns follow at once; at its end the tree is asked whether
   another occurrence can be followed by that word, until a place is marked already. That
   completes the vocabulary of squares.
4. The intervals of the marked places are the occurrences of all squares; those of one
   period that start side by side merge into a run.

Squares of a root that is itself a power are left out in step 2; a turn of a root is a
power only if the root is. Before all that, texts lose the stretches that can hold no run
of ``min_length`` words: a run of m words or more has each of its words in a window of m/2
words that stands in the same text once more (hashes of windows may only keep too much).

Memory is some hundred bytes for each word in such stretches of a slice (about 1 MB of text, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import bound_batches

#: Members of words: all but blank and the controls 9 to 13.
WORD = np.ones(256, dtype=bool)
WORD[[32, 9, 10, 11, 12, 13]] = False


class Minima:
    """Least values of ranges of an array, by a table of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values.astype(np.int32)]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        self.table = np.full((len(self.rows), max(1, len(values))), np.iinfo(np.int32).max, dtype=np.int32)
        for k, row in enumerate(self.rows):
            self.table[k, : len(row)] = row
        del self.rows

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[begin:end), which must not be empty."""
        k = log2(end - begin)
        return np.minimum(self.table[k, begin], self.table[k, end - (1 << k)])

    def reach(self, at: np.ndarray, bound: np.ndarray, forwards: bool) -> np.ndarray:
        """How many values from ``at`` on (or before it) in a row are bound or more."""
        n = self.table.shape[1]
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(len(self.table) - 1, -1, -1):
            begin = at + out if forwards else at - out - (1 << k)
            inside = begin + (1 << k) <= n if forwards else begin >= 0
            ok = inside & (self.table[k, np.where(inside, begin, 0)] >= bound)
            out[ok] += 1 << k
        return out


def log2(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1] - 1


class Tree:
    """The suffix array of a string with the common prefixes of neighbours."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = n = len(symbols)
        ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while True:
            key = ranks[-1] * (n + 1)
            key[: n - width] += ranks[-1][width:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, dtype=np.int64)
            fresh[0] = 0
            np.cumsum(key[order][1:] != key[order][:-1], out=fresh[1:])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1 or width >= n:
                break
            ranks.append(rank)
            width *= 2
        self.order, self.rank = order, rank
        # common prefixes of neighbours, by the ranks of prefixes of 2**k symbols from the longest down
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, n - 1), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            ok = inside & (ranks[k][np.where(inside, a, 0)] == ranks[k][np.where(inside, b, 0)])
            # equal ranks of prefixes cut by the string's end are those of one suffix only, as ends differ
            a[ok] += 1 << k
            b[ok] += 1 << k
            common[ok] += 1 << k
        self.common = Minima(common)
        self.neighbour = common

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, which differ; 0 where one is at the end."""
        out = np.zeros(len(i), dtype=np.int64)
        ok = (i < self.n) & (j < self.n) & (i >= 0) & (j >= 0)
        if ok.any():
            a, b = self.rank[i[ok]], self.rank[j[ok]]
            out[ok] = self.common.least(np.minimum(a, b), np.maximum(a, b))
        return out

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the suffix array of the suffixes that share ``depth`` symbols with the one at ``at``."""
        rank = self.rank[at]
        return rank - self.common.reach(rank, depth, False), rank + self.common.reach(rank, depth, True)

    def earlier_factors(self) -> np.ndarray:
        """For each place, the longest prefix of its suffix that also starts at an earlier place."""
        out = [0] * self.n
        stack: list[tuple[int, int]] = []  # place, and its common prefix with the one below
        common = self.neighbour.tolist()
        for k, place in enumerate(self.order.tolist()):
            shared = common[k - 1] if k else 0
            while stack and stack[-1][0] > place:
                top, below = stack.pop()
                out[top] = max(below, shared)
                shared = min(below, shared)
            stack.append((place, shared if stack else 0))
        while stack:
            top, below = stack.pop()
            out[top] = below
        return np.array(out, dtype=np.int64)


def blocks(factors: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    out, at, sizes = [], 0, factors.tolist()
    while at < len(sizes):
        out.append(at)
        at += max(1, sizes[at])
    out.append(len(sizes))
    return np.array(out, dtype=np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(counts) things, whose it is and its number there."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


class Squares:
    """Squares of a string without powers as roots: the leftmost covering set and the vocabulary."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        self.n = len(symbols)
        self.forward = Tree(symbols)
        self.backward = Tree(symbols[::-1])

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the prefixes that end with i and j."""
        return self.backward.extension(self.n - 1 - i, self.n - 1 - j)

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and root length of squares among which is a start at or before, in the same run, the leftmost of each."""
        edges = blocks(self.forward.earlier_factors())
        begin, end = edges[:-1], edges[1:]
        size = end - begin
        following = np.append(size[1:], 0)
        starts, roots = [], []
        # squares that start in a block, have their middle there and reach past its end
        block, k = spread(size)
        k = k + 1
        left, right = end[block] - k, end[block]
        onward, back = self.forward.extension(right, left), self.before(right - 1, left - 1)
        found = (onward + back >= k) & (onward > 0)
        starts.append(np.maximum(left - back, left - k + 1)[found])
        roots.append(k[found])
        # squares that start before a block and have their middle in it
        block, k = spread(size + following)
        k = k + 1
        left, right = begin[block], begin[block] + k
        onward, back = self.forward.extension(left, right), self.before(left - 1, right - 1)
        found = (onward + back >= k) & (onward > 0) & (back > 0)
        start = np.maximum(left - back, left - k + 1)
        found &= start + k <= end[block]
        starts.append(start[found])
        roots.append(k[found])
        start, root = np.concatenate(starts), np.concatenate(roots)
        return self.proper(start, root)

    def proper(self, start: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose root is no power: for no prime f is it a word f times."""
        rest, ok = root.copy(), np.ones(len(root), dtype=bool)
        f = 2
        while len(rest) and f * f <= rest.max():
            divides = np.flatnonzero((rest % f == 0) & ok)
            ok[divides[self.is_power(start[divides], root[divides], f)]] = False
            while len(divides):
                rest[divides] //= f
                divides = divides[rest[divides] % f == 0]
            f += 1
        left = np.flatnonzero((rest > 1) & ok)
        ok[left[self.is_power(start[left], root[left], rest[left])]] = False
        return start[ok], root[ok]

    def is_power(self, start: np.ndarray, root: np.ndarray, f: np.ndarray | int) -> np.ndarray:
        part = root // f
        return self.forward.extension(start, start + part) >= root - part

    def whole_runs(self, start: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Root, start and last square's start of the distinct runs that these squares stand in."""
        first = start - self.before(start - 1, start + root - 1)
        last = start + self.forward.extension(start, start + root) - root
        key = np.unique(np.stack([root, first, last]), axis=1)
        return key[0], key[1], key[2]

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Root length, first and last place in the suffix array of each distinct square."""
        start, root = self.covering()
        marked = np.zeros((3, 0), dtype=np.int64)
        while len(start):
            root, first, last = self.whole_runs(start, root)
            whose, turn = spread(last - first + 1)
            low, high = self.forward.interval(first[whose] + turn, 2 * root[whose])
            places = np.unique(np.stack([root[whose], low, high]), axis=1)
            marked = np.unique(np.concatenate([marked, places], axis=1), axis=1)
            # the last square of a run, without its first word: can that word follow elsewhere?
            at, word, depth = last + 1, self.symbols[last], 2 * root - 1
            found, start = self.followed(at, depth, word)
            root, start = root[found], start[found]
            low, _ = self.forward.interval(start, 2 * root)
            new = ~np.isin(low * (self.n + 1) + root, marked[1] * (self.n + 1) + marked[0])
            start, root = start[new], root[new]
        return marked[0], marked[1], marked[2]

    def followed(self, at: np.ndarray, depth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether some occurrence of the ``depth`` words at ``at`` is followed by ``word``, and where one is."""
        low, last = self.forward.interval(at, depth)
        end = last + 1
        high = end.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (self.word_after(middle, depth) < word)
            low[less] = middle[less] + 1
            high[open_ & ~less] = middle[open_ & ~less]
        found = (low < end) & (self.word_after(low, depth) == word)
        return found, self.forward.order[np.minimum(low, self.n - 1)]

    def word_after(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The symbol ``depth`` after the suffix at a place of the array; -1 past the end."""
        at = self.forward.order[np.minimum(place, self.n - 1)] + depth
        return np.where(at < self.n, self.symbols[np.minimum(at, self.n - 1)], -1)


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of a string of numbers from 0, by start, then period."""
    if len(symbols) < 2:
        return (np.zeros(0, np.int64),) * 3
    squares = Squares(symbols)
    root, low, high = squares.vocabulary()
    whose, k = spread(high - low + 1)
    start, period = squares.forward.order[low[whose] + k], root[whose]
    by = np.lexsort([start, period])
    start, period = start[by], period[by]
    first = np.append(True, (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)) if len(start) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(start) else first
    begin, period, end = start[first], period[first], start[last] + 2 * period[last]
    by = np.lexsort([period, begin])
    return begin[by], (end - begin)[by], period[by]


def repeated_stretches(hashes: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether it lies in a window of ``width`` words that stands in its row more than once."""
    n = len(hashes)
    covered = np.zeros(n, dtype=bool)
    if n < width:
        return covered
    window = tb.span_hash(tb.prefix_hash(hashes), np.arange(n - width + 1), np.arange(width, n + 1))
    inside = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    key = tb.mix(window[inside] + tb.U64(tb.BASE) * row[inside].astype(tb.U64))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(inside), dtype=bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, inside[twice], 1)
    np.add.at(depth, inside[twice] + width, -1)
    return np.cumsum(depth[:-1]) > 0


def runs_of_texts(data: np.ndarray, offsets: np.ndarray, min_length: int) -> tuple[np.ndarray, ...]:
    """Word starts and ends, each row's first word, and the runs of min_length words or more: start among all words, length, period."""
    starts, ends, first = tb.words(data, offsets, WORD)
    none = np.zeros(0, dtype=np.int64)
    if len(starts) < 2:
        return starts, ends, first, none, none, none
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes = tb.span_hash(tb.prefix_hash(data), starts, ends)
    inside = np.flatnonzero(repeated_stretches(hashes, row, max(1, (min_length + 1) // 2)))
    if not len(inside):
        return starts, ends, first, none, none, none
    raw = data.tobytes()
    numbers: dict[bytes, int] = {}
    named = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts[inside].tolist(), ends[inside].tolist(), strict=True)])
    fresh = np.append(True, (inside[1:] != inside[:-1] + 1) | (row[inside[1:]] != row[inside[:-1]]))
    # a stretch's words, then a symbol of its own
    shift = np.cumsum(fresh) - 1
    string = len(numbers) + np.arange(len(inside) + int(shift[-1]))
    place = np.arange(len(inside)) + shift
    string[place] = named
    word_at = np.full(len(string), -1, dtype=np.int64)
    word_at[place] = inside
    begin, length, period = runs_of(string)
    long = length >= min_length
    return starts, ends, first, word_at[begin[long]], length[long], period[long]


def collapsed_bytes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space: bytes and offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[kept]
    begin, end = starts[kept], ends[kept]
    joined = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, dtype=bool)
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    edge[begin] += 1
    edge[end] -= 1
    keep = np.cumsum(edge[:-1]) > 0
    keep[end[joined]] = True  # the first white space after a word that another follows
    out = data.copy()
    out[end[joined]] = 32
    sizes = np.bincount(row, weights=end - begin + joined, minlength=len(offsets) - 1).astype(np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])


def periodic_runs(docs: DataFrame, min_length: int = 12, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``n_words``, ``runs`` (structs of start, length and period, in words from 0, by start, then period)
    of max(min_length, 2 * period) words or more, and ``collapsed``: the words joined by one space, without those
    that some run contains after its first period.

    A null text has no words and is collapsed to the empty text, as is one without words; repeated rows are judged each
    for itself; an empty table gives no rows. Only the columns named in ``keep`` are carried, so others may have any names.
    """
    chosen = docs.select(*[f"`{c}`" for c in keep], "text")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(len(keep))):
                starts, ends, first, begin, length, period = runs_of_texts(data, offsets, min_length)
                edge = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(edge, begin + period, 1)
                np.add.at(edge, begin + length, -1)
                text, cuts = collapsed_bytes(data, offsets, starts, ends, first, np.cumsum(edge[:-1]) == 0)
                by = np.lexsort([period, begin])
                begin, length, period = begin[by], length[by], period[by]
                counts = np.searchsorted(begin, first)
                within = begin - np.repeat(first[:-1], np.diff(counts))
                runs = pa.StructArray.from_arrays([pa.array(within), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), runs)
                joined = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))).cast(pa.string())
                columns = [batch.column(k).slice(row, end - row) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first).astype(np.int64)), lists, joined], names=[*keep, "n_words", "runs", "collapsed"])
        tb.trim()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(run, ", ".join([*fields, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"]))
