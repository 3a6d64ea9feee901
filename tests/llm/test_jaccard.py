import random
import re

import numpy as np

from corpusloom.llm import jaccard


def brute(rows, size, threshold):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    rows, number = [], 0
    for _ in range(14):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(3, 120))]
        if draw.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            text = " ".join(copy)
            rows.append((number, text.upper() if draw.random() < 0.2 else text))
            number += 1
    rows += [(number, rows[0][1]), (number, "a b"), (number + 1, "a  b\n"), (number + 2, None), (number + 3, ""), (number + 4, " \t"), (None, rows[0][1]), (None, "alone in this"), (number + 5, "long " * 20_000)]
    draw.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    for seed, size, threshold in ((1, 4, 85), (2, 5, 80), (3, 3, 60)):
        rows = corpus(seed)
        got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, threshold).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(brute(rows, size, threshold), key=str)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, None, None, None)], "doc_id long, text string, n long, class_id int")
    assert sorted(r.doc_id for r in jaccard.deduplicated(docs).collect()) == [1, 3]
    assert jaccard.deduplicated(docs).columns == docs.columns
    assert jaccard.similarity_components(docs.limit(0)).count() == 0


def check(spark, rows, size, threshold):
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, threshold).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(brute(rows, size, threshold), key=str)


def test_a_null_id_is_a_bridge(spark):
    """A and B are linked only through a document without an id."""
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words[:110])), (None, " ".join(words[5:115])), (2, " ".join(words[10:120]))]
    assert brute(rows, 1, 91)[0][2] == brute(rows, 1, 91)[2][2] == 1
    check(spark, rows, 1, 91)


def test_tiles_and_products(spark, monkeypatch):
    """A group below and above the threshold in many pairs, in tiles of few classes, by the whole product and by pairs."""
    draw = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(draw.randint(1, 3)):
            own[draw.randrange(60)] = f"x{draw.randint(0, 40)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "TILE", 8 * jaccard.ROW_CELLS)
    monkeypatch.setattr(jaccard, "FEW_PAIRS", 5)
    monkeypatch.setattr(jaccard, "bounded", lambda pairs, classes, threshold: pairs.limit(0).select("a", "b"))  # no centre links
    check(spark, rows, 3, 75)


def test_block_overlaps_equal_sets():
    draw = random.Random(7)
    sets = [set(draw.sample(range(60), draw.randint(1, 40))) | ({1000 + i} if i % 2 else set()) for i in range(90)]
    keys = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    n = np.array([len(k) for k in keys])
    whole = jaccard.block_overlaps(keys, n)
    p, q = np.triu_indices(90, 1)
    want = [len(sets[a] & sets[b]) for a, b in zip(p.tolist(), q.tolist())]
    assert whole[p, q].astype(int).tolist() == want == jaccard.pair_overlaps(keys, n, p, q).tolist()


def test_size_ranges_hold_partners():
    for threshold in (60, 80, 85, 99, 100):
        for n in range(1, 3000, 7):
            most = 100 * n // threshold
            low, high = jaccard.size_range(np.array([n, most]), threshold).tolist()
            assert high - low <= 1


def test_one_row_of_each_component_stays(spark):
    """Repeated ids, repeated rows, an id on two texts, and a column named as the operator names its own."""
    long = " ".join(f"k{i}" for i in range(40))
    rows = [(1, long, 1, "a"), (1, long, 1, "a"), (1, "other words of a clean text here", 2, "b"), (2, long + " tail", 3, "c"), (None, long, 4, "d"), (3, None, 5, "e"), (3, None, 5, "e"), (4, " \n", 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int, text_key string")
    out = jaccard.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=str)


def test_texts_meet_by_name_beyond_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BITS", 4)
    check(spark, corpus(2)[:40], 4, 85)
