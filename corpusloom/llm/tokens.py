"""Token ids of whole texts by a public tokenizer file, through a memo of text units.

A unit is a run of blanks and newlines with the run of other characters after it (or
the trailing run alone). The tokenizer's pre-tokens never reach across a unit's end,
so a text's ids are its units' ids in order, and each distinct unit is encoded once a
worker. Texts for which that does not hold (other white space, or the strings of
special tokens) are encoded whole.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np

from corpusloom.llm import textbytes as tb

#: Units, and ids of units, held by a worker before the memo starts anew; a slice may add what it has.
MEMO_UNITS, MEMO_IDS = 1_000_000, 4_000_000
#: Bytes of new units that are encoded as one string, about.
JOINED = 1 << 15
#: ASCII white space other than blank and newline, and the bytes that begin any wider one.
ODD = np.zeros(256, dtype=bool)
ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
WIDE = ("\u0085", " ", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")


class UnitTokenizer:
    """Encodes slices of texts; keeps a sorted array of unit hashes beside their ids."""

    def __init__(self, path: str, other_encoder: bool = False) -> None:
        """``other_encoder``: units by the quicker encoder of the same vocabulary, if its file stands beside; ids are equal."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None
        stage = spec.get("pre_tokenizer") or {}
        self.by_unit = plain and stage.get("type") == "ByteLevel" and not stage.get("add_prefix_space") and stage.get("use_regex", True)
        self.bytes_of = self._lengths() if self.by_unit else None
        self.fast = self._ranks(path) if self.by_unit and other_encoder else None
        self.clear()

    def _ranks(self, path: str):
        """The same vocabulary in the quicker encoder, where its file stands beside the other; ids are equal."""
        other = os.path.splitext(path)[0] + ".tiktoken"
        try:
            import tiktoken
            from public_tokenizers import PATTERN
        except ImportError:
            return None
        if not os.path.exists(other):
            return None
        with open(other, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _lengths(self) -> np.ndarray:
        """Bytes that each id stands for: a character of a byte-level token is a byte."""
        out = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[k] = len(token)
        return out

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has.

        Units that begin with a blank and end with none are put together: their pre-tokens end where they end, and the
        bytes that the ids stand for tell the units apart. Others, and strings where that fails, are encoded one by one.
        """
        if self.fast is not None:
            lists = [np.array(self.fast.encode_ordinary(u.decode()), dtype=np.uint32) for u in units]
            return np.concatenate(lists), np.array([len(x) for x in lists])
        joins = [u[0] in (32, 10) and u[-1] not in (32, 10) for u in units]
        lists: list = [None] * len(units)
        groups: list[list[int]] = [[]]
        size = 0
        for k, ok in enumerate(joins):
            if ok:
                if size > JOINED:
                    groups.append([])
                    size = 0
                groups[-1].append(k)
                size += len(units[k])
        alone = [k for k, ok in enumerate(joins) if not ok]
        groups = [g for g in groups if g]
        strings = [b"".join(units[k] for k in g).decode() for g in groups]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, dtype=np.uint32)
            ends = np.cumsum([len(units[k]) for k in group])
            reach = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(reach, ends)
            if len(reach) == 0 or reach[-1] != ends[-1] or not (reach[cut] == ends).all():
                alone += group
                continue
            first = np.concatenate([[0], cut[:-1] + 1])
            for k, a, b in zip(group, first.tolist(), (cut + 1).tolist(), strict=True):
                lists[k] = ids[a:b]
        for k, encoding in zip(alone, self.tokenizer.encode_batch_fast([units[k].decode() for k in alone], add_special_tokens=False), strict=True):
            lists[k] = np.array(encoding.ids, dtype=np.uint32)
        return np.concatenate(lists), np.array([len(x) for x in lists])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's first place among them."""
        rows = len(offsets) - 1
        odd = self._odd_rows(data, offsets) if self.by_unit else np.ones(rows, dtype=bool)
        blank = (data == 32) | (data == 10)
        begin = np.zeros(len(data), dtype=bool)
        if len(data):
            begin[1:] = blank[1:] & ~blank[:-1]
            begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(rows), np.diff(first))
        plain = ~odd[row] if len(row) else np.zeros(0, dtype=bool)
        hashes = tb.span_hash(tb.prefix_hash(data), starts, ends)[plain]
        places = self._places(hashes, starts[plain], ends[plain], data)
        length = np.diff(self.first)[places]
        begin_at = self.first[places]
        total = int(length.sum())
        ids = self.ids[np.repeat(begin_at - np.cumsum(length) + length, length) + np.arange(total)]
        sizes = np.bincount(row[plain], weights=length, minlength=rows).astype(np.int64)
        if odd.any():
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            pieces = [ids[bounds[i] : bounds[i + 1]] for i in range(rows)]
            for i, own in zip(np.flatnonzero(odd).tolist(), self.whole(texts), strict=True):
                pieces[i], sizes[i] = own, len(own)
            ids = np.concatenate(pieces)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, dtype=bool)
        at = [np.flatnonzero(ODD[data])]
        raw = data.tobytes()
        for mark in [*(m.encode() for m in WIDE), *self.special]:
            spot = raw.find(mark)
            while spot >= 0:
                row = int(np.searchsorted(offsets, spot, "right")) - 1
                out[row] = True
                spot = raw.find(mark, int(offsets[row + 1]))
        out[np.searchsorted(offsets, at[0], "right") - 1] = True
        return out

    def _places(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The memo slot of each unit, after encoding those not met before."""
        if len(self.hashes) > MEMO_UNITS or len(self.ids) > MEMO_IDS:
            self.clear()
        kinds, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, kinds)
        known = np.zeros(len(kinds), dtype=bool)
        inside = spot < len(self.hashes)
        known[inside] = self.hashes[spot[inside]] == kinds[inside]
        slots = np.zeros(len(kinds), dtype=np.int64)
        slots[known] = self.slots[spot[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            ids, sizes = self.encode_units([raw[starts[k] : ends[k]] for k in at[new].tolist()])
            slots[new] = len(self.first) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.hashes = np.insert(self.hashes, spot[new], kinds[new])
            self.slots = np.insert(self.slots, spot[new], slots[new])
        return slots[back]
