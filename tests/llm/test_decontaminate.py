import hashlib
import random
import re

import numpy as np

from corpusloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    held = {}
    for item, text in items:
        own = words(text)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            held.setdefault(tuple(own[k : k + n]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(k) for k in held}:
            for k in range(len(own) - n + 1):
                if names := held.get(tuple(own[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def corpus():
    draw = random.Random(6)
    vocabulary = ["ab", "cd", "Ef", "gé", "日本", "x1"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([4, 9, 10, 14, 30])))) for i in range(25)]
    items += [(26, None), (27, "..."), (3, items[3][1]), (28, items[4][1]), (29, items[20][1])]
    docs = []
    for i in range(150):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.5:
            own = words(draw.choice(items)[1])
            a = draw.randint(0, len(own))
            text[len(text) // 2 : len(text) // 2] = own[a : a + draw.randint(0, 20)]
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(text)))
    return [*docs, (200, None), (201, ""), (202, " ".join(docs[0][1].split()) + " ab" * 30_000), (5, docs[5][1]), (None, items[0][1])], items


def test_equals_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:6] for r in decontaminate.contamination(frame, bench).collect()]
    want = brute(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_longest_matches_are_verbatim(spark):
    docs, items = corpus()
    own = {str(i): words(t) for i, t in items}
    texts = {i: words(t) for i, t in docs}
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert found
    for r in found:
        d, b = texts[r.doc_id], own[r.item_id]
        assert d[r.doc_word : r.doc_word + r.n_words] == b[r.item_word : r.item_word + r.n_words]
        after = (d[r.doc_word + r.n_words :][:1], b[r.item_word + r.n_words :][:1])
        assert not after[0] or after[0] != after[1]


def test_blocks_and_empty_tables(spark):
    docs, items = corpus()
    frame, bench = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.blocks_of(bench, 10, block_words=100)[1]) > 3
    got = [tuple(r)[:6] for r in decontaminate.contamination(frame, bench, block_words=100).collect()]
    want = brute(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.remove_contaminated(frame, bench, block_words=100)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])
    one = decontaminate.contamination(frame, bench).select("doc_id", "longest").collect()
    assert sorted(one, key=str) == sorted(decontaminate.contamination(frame, bench, block_words=100).select("doc_id", "longest").collect(), key=str)
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(frame, bench.limit(0)).collect())
    assert decontaminate.remove_contaminated(frame, bench.limit(0)).count() == len(docs)


def test_words_are_compared_where_hashes_agree(monkeypatch):
    """With word hashes of one bit nearly every window seems to match; only real ones are reported."""
    weak = lambda prefix, start, end: tb_span(prefix, start, end) & np.uint64(1)
    tb_span = decontaminate.tb.span_hash
    monkeypatch.setattr(decontaminate.tb, "span_hash", weak)
    docs, items = corpus()
    docs = [(i, t) for i, t in docs if t and len(t) < 2000]
    block = decontaminate.make_block([i for i, _ in items], [t for _, t in items])
    raw = [t.encode() for _, t in docs]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    found = decontaminate.judged(block, block.begins(), np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, 10)
    first = found.words.first
    got = [(d, int(first[i + 1] - first[i]), int(found.hit[first[i] : first[i + 1]].sum()), len(found.items[i])) for i, (d, _) in enumerate(docs)]
    assert got == [w[:4] for w in brute(docs, items)]


def test_uses_in_parts(monkeypatch):
    docs, items = corpus()
    block = decontaminate.make_block([i for i, _ in items], [t for _, t in items])
    raw = [(t or "").encode() for _, t in docs]
    words = decontaminate.words_of(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
    test, at = decontaminate.search(block, block.begins(), words, 10)
    rows = lambda: sorted(tuple(int(x[k]) for x in part) for part in decontaminate.longest_matches(block, words, test, at) for k in range(len(part[0])))
    whole = rows()
    monkeypatch.setattr(decontaminate, "USES", 3)
    assert whole and rows() == whole
