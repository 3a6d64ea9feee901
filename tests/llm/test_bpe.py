"""Encoding against the library that reads the same rank file, decoding against the texts."""

import base64
import hashlib
import os
import random

import numpy as np
import pytest

from corpusloom.llm import bpe
from corpusloom.llm.queries import op12_bpe

FOLDER = "/root/testdata/sf0.001"
BITS = ["a", "b", "e", " ", " ", "\n", "\t", "é", "'s", "'", "1", "!", "  ", " the", " ", "　", "\x1c", "<|endoftext|>", "日本", "ß", "ee", "---", "😀", "̀"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(bpe.tokenizer_path(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.tokenizer_path(), bpe.pre_tokens())


def listed(ids):
    return np.frombuffer(ids, dtype="<u4").tolist()


def test_units_equal_the_library(own, library):
    draw = random.Random(12)
    texts = ["", " ", "  ", "\n ", *("".join(draw.choice(BITS) for _ in range(draw.randint(0, 14))) for _ in range(3000))]
    own.clear()
    for k in range(0, len(texts), 500):
        got = own.encode(texts[k : k + 500])
        assert [listed(x) for x in got] == [library.encode_ordinary(t) for t in texts[k : k + 500]]
        assert own.decode(got) == [t.encode() for t in texts[k : k + 500]]


def test_query_and_heap_agree_with_the_library(own, library):
    draw = random.Random(13)
    words = [bytes(draw.choice(b"abcdehnostu") for _ in range(draw.randint(2, 60))) for _ in range(300)]
    words += [b"e" * n for n in range(2, 40)] + [b"th" * 30, b"-" * 200, b"a" * bpe.LONG, "ш".encode() * 100]
    want = [library.encode_ordinary(w.decode()) for w in words]
    assert [listed(x) for x in own.contract_by_query(words)] == want
    assert [listed(own.contract_by_heap(w)) for w in words] == want


def test_words_of_any_length(own, library):
    draw = random.Random(14)
    texts = ["e" * 30_000, "".join(draw.choice("abcdefgh") for _ in range(20_000)), "".join(chr(draw.randint(0x4E00, 0x9000)) for _ in range(5000)), " " * 3000 + "x" + " " * 3000, "a b " * 50_000]
    got = own.encode(texts)
    assert [listed(x) for x in got] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(got) == [t.encode() for t in texts]


def test_memo_is_bounded_and_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 4000)
    own.clear()
    for k in range(30):
        text = " ".join(f"w{k}x{i}" for i in range(20)) + " " + "z" * 150
        assert listed(own.encode([text])[0]) == library.encode_ordinary(text)
        assert own.held <= 4000 + 42 * 300 and "z" * 150 not in own.later


def test_unknown_ids_are_refused(own):
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode([np.array([10**6], dtype="<u4").tobytes()])


def test_columns_nulls_and_empty_tables(spark, library):
    rows = [(1, None, "i"), (None, "", "j"), (1, "one two", "k"), (1, "one two", "k"), (2, "naïve — 日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, listed(r.ids), bytes(r.bytes)) for r in got) == sorted((k or 0, library.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in rows)
    assert op_rows(bpe.encode(docs.limit(0))) == [] == op_rows(bpe.decode(bpe.encode(docs.limit(0))))


def op_rows(frame):
    return frame.collect()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op12_bpe(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
