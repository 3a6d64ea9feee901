import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import substrings
from corpusloom.llm.suffixarray import suffix_array


def test_suffix_array_equals_sorting():
    draw = random.Random(3)
    for _ in range(1500):
        text = bytes(draw.randint(0, draw.choice([1, 2, 4])) for _ in range(draw.randint(0, 30))) * draw.choice([1, 1, 2, 3])
        assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, length):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = set(), []
    for doc_id, text in ordered:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, odd):
    draw = random.Random(seed)
    words = ["alpha", "beta", "gämma", "d", "epsilon", "zz"]
    line = " ".join(draw.choice(words) for _ in range(30))
    rows = []
    for i in range(40):
        text = " ".join(draw.choice(words) + str(draw.randint(0, 30)) for _ in range(draw.randint(0, 120)))
        if draw.random() < 0.6:
            at = draw.randint(0, len(text))
            text = text[:at] + line + text[at:]
        if rows and draw.random() < 0.5:
            other = draw.choice(rows)[1]
            a = draw.randint(0, len(other))
            text += other[a : a + draw.randint(0, 600)]
        rows.append((i, text))
    rows += [(50, "ab" * 400), (51, "a" * 700), (52, "x" * 99), (53, ""), (54, None), (55, rows[3][1]), (56, "long text " * 20_000)]
    return rows + [(7, rows[9][1]), (8, rows[8][1]), (8, rows[8][1]), (None, rows[1][1]), (None, None)] if odd else rows


@pytest.mark.parametrize(("odd", "length"), [(False, 100), (True, 100), (False, 40)])
def test_equals_brute_force(spark, odd, length):
    rows = corpus(int(odd), odd)
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, n_bytes int, key string").repartition(4)
    got = sorted(map(tuple, substrings.summary(docs, length).collect()), key=str)
    assert got == brute(rows, length)


def test_empty_table(spark):
    assert substrings.summary(spark.createDataFrame([], "doc_id long, text string")).count() == 0
