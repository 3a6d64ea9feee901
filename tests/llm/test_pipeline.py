import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import packing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "green", "walk", "light") for b in ("a", "b", "c", "d", "e", "f", "g")]
    item = " ".join(f"item{i}" for i in range(14))
    docs, labels = [], []
    for i in range(240):
        words = [draw.choice(vocabulary) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            words[5] = words[30] = words[40] = draw.choice(["grubwort", "snivelork"])
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs.append((300, docs[1][1], "en", "s", 0))
    docs.append((301, docs[2][1] + " tail", "en", "s", 0))
    docs.append((302, "before " + item + " after", "en", "s", 0))
    docs.append((303, "word token = abcdef0123456789 end", "en", "s", 0))
    docs += [(304, None, None, None, None), (305, "", "en", "s", 0), (306, "long text of many words " * 3000, "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


def test_stages_and_packing(spark, tables):
    folder, docs = tables
    state, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = state.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = spark.createDataFrame(stage(spark, state, folder).collect(), state.schema)
        assert state.columns == columns, name
        seen.append({r.doc_id for r in state.collect()})
    toxic = {i for i in range(240) if i % 4 == 0}
    everything = {d[0] for d in docs}
    assert seen[0] == everything - toxic
    assert seen[1] == seen[0] - {300, 301}
    assert seen[2] == seen[1] - {302}
    assert seen[3] == seen[2]
    texts = {r.doc_id: r.text for r in state.collect()}
    assert texts[303] == "word [REDACTED] end" and texts[304] is None
    out = corpus_pipeline.run(spark, folder).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.piece):
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)


def test_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_repeated_ids_and_nulls(spark, tables):
    """Stages keep columns whose names their operators use, rows that share a doc_id, and rows without id or text."""
    folder, _ = tables
    clean = "a plain text about the weather of the northern coast in early spring days"
    rows = [(1, clean, "en", "s", 0, 7, "x", "y"), (1, "another text of the same number with its own words and its own meaning", "en", "s", 0, 8, "x", "y"), (None, clean + " again and more of it", None, None, None, None, None, None),
            (2, None, "en", "s", 0, 9, "x", "y"), (2, None, "en", "s", 0, 9, "x", "y"), (None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, "x", "y"), (4, "word " * 60_000, "en", "s", 300_000, 2, "x", "y"), (5, clean, "en", "s", 0, 3, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __gone int, spans string, text_key string")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = spark.createDataFrame(stage(spark, state, folder).collect(), docs.schema)
        assert state.columns == docs.columns, name
    left = [tuple(r) for r in state.collect()]
    assert sorted(left, key=str) == sorted(rows[:-1], key=str)  # the copy of document 1 goes, whatever else shares its number
    packed = corpus_pipeline.STAGES[-1][1](spark, state, folder).collect()
    assert sum(r.length == 1 for r in packed) == 4 and {r.doc_id for r in packed} == {1, 2, 3, 4, None}
