"""Byte-level BPE by DuckDB: encoding by recursive contraction, decoding by ordered aggregation.

A rank file gives the bytes of each token; a pair of tokens may be merged when their bytes
together are a token, whose id is the pair's rank. Inside each Spark task the words
(matches of the pre-token pattern) not met before go to one DuckDB query: its rows are a
word's tokens by position, each with its right neighbour and what the two would merge
to (looked up in the merge table where one of them is new), and each step of a recursive query contracts the leftmost pair of the least rank in
every word, until no word has a pair left. Decoding joins ids with the token bytes and
puts them together in order of position.

A step costs as many rows as its words have tokens, so a word of more than ``LONG`` bytes would take
the square of its length; those are contracted in the same order by a heap, and tested to
give the same ids as the query.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts of any length are taken whole (one text
is one value); equal texts have equal ids; special tokens' strings are ordinary text; an
empty table gives no rows. Only the columns named in ``keep`` are carried, so other columns may have any names.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import bound_batches

#: Bytes above which a word is contracted by a heap.
LONG = 256
#: Rows that a recursive query may make, about; tokens of one decoding query.
QUERY_ROWS, DECODE_TOKENS = 1_000_000, 1 << 18
#: What a task's memo may hold before it starts anew, and the longest unit that stays in it.
MEMO_BYTES, MEMO_UNIT = 96 << 20, 96
#: What an entry of the memo takes besides its characters, about.
ENTRY_BYTES = 200
#: A blank inside a run of white space, not its last place before a word: there a text cannot be cut.
UNCUT = re.compile(r" (?:(?=\s)(?<=\s )|$(?<=\s ))")

CONTRACT = """
WITH RECURSIVE state(step, w, p, l, r, merged) AS (
  SELECT 0, s.w, s.p, s.l, s.r, m.id FROM start s LEFT JOIN merges m ON s.l * 4294967296 + s.r = m.pair
  UNION ALL
  SELECT n.step, n.w, n.p, n.l, n.r, CASE WHEN n.pair IS NULL THEN n.merged ELSE m.id END
  FROM (
    SELECT s.step + 1 AS step, s.w, CASE WHEN s.p > h.p THEN s.p - 1 ELSE s.p END AS p, s.merged,
           CASE WHEN s.p = h.p + 1 THEN h.id ELSE s.l END AS l, CASE WHEN s.p = h.p - 1 THEN h.id ELSE s.r END AS r,
           CASE WHEN s.p = h.p + 1 THEN h.id * 4294967296 + s.r WHEN s.p = h.p - 1 THEN s.l * 4294967296 + h.id END AS pair
    FROM state s JOIN (
      SELECT w, CAST(best & 65535 AS INTEGER) AS p, best >> 16 AS id
      FROM (SELECT w, min(merged * 65536 + p) AS best FROM state WHERE merged IS NOT NULL GROUP BY w)
    ) h ON s.w = h.w
    WHERE s.p <> h.p
  ) n LEFT JOIN merges m ON n.pair = m.pair
)
SELECT s.w, s.l FROM state s JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) e ON s.w = e.w AND s.step = e.step
ORDER BY s.w, s.p
"""

DECODE = "SELECT d.doc, array_to_string(list(v.chars ORDER BY d.place), '') AS chars FROM tokens d JOIN vocabulary v ON d.id = v.id GROUP BY d.doc"

_CODECS: dict[tuple[str, str], Codec] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, kept by a worker: its size is the vocabulary's."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


class Codec:
    """A rank file as DuckDB tables, and a memo of the ids of text units."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.known = np.zeros(max(self.ranks.values()) + 2, dtype=bool)
        self.known[list(self.ranks.values())] = True
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        splits = [(self.ranks[t[:i]], self.ranks[t[i:]], k) for t, k in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs = pa.array([a << 32 | b for a, b, _ in splits], pa.int64())
        self.merges = {(a, b): k for a, b, k in splits}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self.load("merges", pa.table({"pair": pairs, "id": pa.array([k for _, _, k in splits], pa.int64())}))
        # a byte is the character of its number, so that text functions can put bytes together
        self.load("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "chars": [t.decode("latin-1") for t in self.ranks]}))
        self.clear()

    def load(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def clear(self) -> None:
        """Forgets all units. ``first`` has those that begin a text, ``later`` those after a blank, which is left out of the key."""
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.held = 0

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        rows = np.cumsum([len(w) * (len(w) + 1) // 2 for w in words])
        begin = 0
        while begin < len(words):
            done = int(rows[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(rows, done + QUERY_ROWS, "right")))
            out += self.contract_by_query(words[begin:end])
            begin = end
        return out

    def contract_by_query(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        right = np.append(symbols[1:], -1)
        right[ends - 1] = -1
        place = np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)
        start = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "p": place.astype(np.int32), "l": symbols, "r": right})
        self.db.register("start", start)
        found = self.db.execute(CONTRACT).fetchnumpy()
        self.db.unregister("start")
        ids = np.asarray(found["l"]).astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(np.asarray(found["w"]), np.arange(len(words) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def contract_by_heap(self, word: bytes) -> bytes:
        """The same for one word, by a heap of pairs and a list of neighbours."""
        token = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, token[i], token[i + 1]) for i in range(n - 1) if (k := self.merges.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue  # one of the two has been merged since
            token[i], token[j] = merged, -1
            after[i] = following = after[j]
            if following < n:
                before[following] = i
                if (k := self.merges.get((merged, token[following]))) is not None:
                    heapq.heappush(heap, (k, i, merged, token[following]))
            if (h := before[i]) >= 0 and (k := self.merges.get((token[h], merged))) is not None:
                heapq.heappush(heap, (k, h, token[h], merged))
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of texts, each matched by the pattern (letters alone are one match) and contracted word by word."""
        find = self.pattern.findall
        raw = [u.encode() for u in units]
        matches = {i: [w.encode() for w in find(u)] for i, u in enumerate(units) if not (u[1:].isalpha() and (u[0] == " " or u[0].isalpha()))}
        alone = [w for i, w in enumerate(raw) if i not in matches]
        ids: dict[bytes, bytes] = {}
        rest: list[bytes] = []
        for w in dict.fromkeys(chain(alone, *matches.values())):
            if (k := self.ranks.get(w)) is not None:
                ids[w] = k.to_bytes(4, "little")
            elif len(w) > LONG:
                ids[w] = self.contract_by_heap(w)
            else:
                rest.append(w)
        ids.update(zip(rest, self.contract(rest), strict=True) if rest else ())
        return [b"".join(map(ids.__getitem__, matches[i])) if i in matches else ids[w] for i, w in enumerate(raw)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts are cut before blanks where the pattern cuts them too, and units met before are known."""
        out: list[bytes | None] = [None] * len(texts)
        cut = {i: t.split(" ") for i, t in enumerate(texts) if not UNCUT.search(t)}
        starts = {i: p.pop(0) for i, p in cut.items()}
        new_first = set(starts.values()) - self.first.keys()
        new_later = set().union(*cut.values()) - self.later.keys()
        keys = [*new_first, *new_later]
        whole = [i for i in range(len(texts)) if i not in cut]
        found = self.encode_units([*new_first, *(f" {u}" for u in new_later), *(texts[i] for i in whole)])
        n = len(new_first)
        self.first.update(zip(keys[:n], found[:n], strict=True))
        self.later.update(zip(keys[n:], found[n : len(keys)], strict=True))
        for i, ids in zip(whole, found[len(keys) :], strict=True):
            out[i] = ids
        for i, parts in cut.items():
            out[i] = self.first[starts[i]] + b"".join(map(self.later.__getitem__, parts))
        self.held += sum(map(len, keys)) + sum(map(len, found[: len(keys)])) + len(keys) * ENTRY_BYTES
        if self.held > MEMO_BYTES:
            self.clear()
        else:
            for memo in (self.first, self.later):
                for k in [k for k in keys if len(k) > MEMO_UNIT]:
                    memo.pop(k, None)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids."""
        sizes = np.array([len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        if len(flat) and not self.known[np.minimum(flat, len(self.known) - 1)].all():
            raise ValueError("an id is not in the vocabulary")
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        parts: list[list[bytes]] = [[] for _ in ids]
        for k in range(0, len(flat), DECODE_TOKENS):
            run = slice(k, k + DECODE_TOKENS)
            self.db.register("tokens", pa.table({"doc": docs[run], "place": np.arange(len(flat[run]), dtype=np.int32), "id": flat[run]}))
            for doc, chars in self.db.execute(DECODE).fetchall():
                parts[doc].append(chars.encode("latin-1"))
            self.db.unregister("tokens")
        return [b"".join(p) for p in parts]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``ids``: the token ids of ``text`` as little-endian unsigned 32-bit numbers, one after another.

    ``path`` is a rank file that all executors can open; ``pattern`` the pre-token pattern of the vocabulary.
    """
    path, pattern = path or tokenizer_path(), pattern or pre_tokens()
    chosen = docs.select(*[f"`{c}`" for c in keep], "text")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(len(keep))):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [batch.column(k).slice(row, end - row) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own.encode(texts), pa.binary())], names=[*keep, "ids"])
        own.clear()
        tb.trim()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(run, ", ".join([*fields, "ids binary"]))


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``ids`` and ``bytes``, what the ids stand for."""
    path, pattern = path or tokenizer_path(), pattern or pre_tokens()
    chosen = tokens.select(*[f"`{c}`" for c in keep], "ids")
    bound_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            values = batch.column(len(keep)).to_pylist()
            begin = 0
            while begin < len(values):
                end, size = begin, 0
                while end < len(values) and (end == begin or size + len(values[end] or b"") <= 1 << 20):
                    size += len(values[end] or b"")
                    end += 1
                columns = [batch.column(k).slice(begin, end - begin) for k in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own.decode([v or b"" for v in values[begin:end]]), pa.binary())], names=[*keep, "ids", "bytes"])
                begin = end
        tb.trim()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields]
    return chosen.mapInArrow(run, ", ".join([*fields, "bytes binary"]))


def pre_tokens() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
