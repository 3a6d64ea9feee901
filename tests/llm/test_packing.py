import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import packing, tokens
from corpusloom.llm import textbytes as tb


def check_bins(bins, capacity):
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def test_plan_places_every_piece():
    draw = random.Random(1)
    for _ in range(200):
        capacity = draw.choice([10, 30, 64])
        counts = {draw.randint(1, capacity): draw.randint(1, 9) for _ in range(draw.randint(1, capacity))}
        bins, placed = defaultdict(list), defaultdict(int)
        for n, low, high, first, each, offset in packing.plan(counts, capacity):
            for rank in range(low, high):
                turn = rank - low
                bins[first + turn // each].append((offset + turn % each * n, n))
                placed[n] += 1
        assert dict(placed) == counts
        check_bins(bins, capacity)


@pytest.mark.parametrize("other_encoder", [False, True])
def test_unit_tokenizer_equals_the_library(other_encoder):
    encoder = tokens.UnitTokenizer(packing.tokenizer_path(), other_encoder)
    draw = random.Random(2)
    bits = ["a", "b", " ", "\n", "\t", "é", "'s", "1", "!", " ", "  ", " the", " ", "<|endoftext|>", "日"]
    texts = ["", *("".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(800))]
    for row, end, data, offsets in tb.slices(pa.array(texts), 900):
        ids, first = encoder.encode(data, offsets)
        for i in range(end - row):
            assert ids[first[i] : first[i + 1]].tolist() == encoder.tokenizer.encode(texts[row + i], add_special_tokens=False).ids


def test_pack_round_trip(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["one", "two", "three"]) for _ in range(draw.randint(0, 900)))) for i in range(80)]
    rows += [(100, None), (101, ""), (3, rows[3][1]), (102, "word " * 9000), (None, "x")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, piece string").repartition(3)
    out = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    check_bins(bins, packing.CAPACITY)
    assert len(bins) <= -(-sum(r.length for r in out) // packing.CAPACITY) + 3
    assert sorted(r.length for r in out if r.doc_id in (100, 101)) == [1, 1]
    parts = sorted((r.piece, r.length, r.start) for r in out if r.doc_id == 102)
    assert all(n == packing.CAPACITY for p, n, _ in parts if p) and parts[0][1] <= packing.CAPACITY
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_memo_is_bounded_by_its_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_IDS", 2000)
    encoder = tokens.UnitTokenizer(packing.tokenizer_path())
    draw = random.Random(4)
    for _ in range(20):
        text = "".join(chr(draw.randint(0x4E00, 0x9000)) for _ in range(700))  # no blanks: a unit of its own
        data, offsets = np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())])
        ids, _ = encoder.encode(data, offsets)
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.ids) <= 2000 + len(ids)
