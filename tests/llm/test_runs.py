"""Runs against every period tried at every place, and the query against the contract in plain Python."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import runs
from corpusloom.llm.queries import op13_runs

FOLDER = "/root/testdata/sf0.001"


def brute(words, least):
    """All (start, length, smallest period) by comparing words q apart for every q."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and (i, j + q - i) not in seen:
                seen.add((i, j + q - i))
                out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted((i, n_, q) for i, n_, q in out if n_ >= least)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences(draw):
    for _ in range(400):
        yield [draw.choice("ab" if draw.random() < 0.5 else "abcd") for _ in range(draw.randint(0, 60))]
    for _ in range(100):
        words = []
        while len(words) < 120:
            unit = [draw.choice("abc") for _ in range(draw.randint(1, 9))]
            words += (unit * draw.randint(1, 5))[: draw.randint(1, 40)]
        yield words
    yield from (list(fibonacci(n)) for n in (13, 90, 300))
    yield list("a" * 100)
    yield list("ab" * 70 + "c" + "ab" * 70)


def test_runs_of_strings():
    for words in sequences(random.Random(1)):
        got = list(zip(*(x.tolist() for x in runs.runs_of(np.array([ord(w) - 97 for w in words], dtype=np.int64))), strict=True))
        assert got == brute(words, 2), words


def test_covering_squares_and_vocabulary():
    draw = random.Random(2)
    for _ in range(200):
        words = [draw.choice("ab" if draw.random() < 0.6 else "abc") for _ in range(draw.randint(2, 40))]
        symbols = np.array([ord(w) for w in words], dtype=np.int64)
        squares = runs.Squares(symbols)
        n = len(words)
        root = lambda w: next(p for p in range(1, len(w) + 1) if len(w) % p == 0 and w == w[:p] * (len(w) // p))
        all_of = {}
        for k in range(1, n // 2 + 1):
            for i in range(n - 2 * k + 1):
                w = "".join(words[i : i + 2 * k])
                if w[:k] == w[k:] and root(w[:k]) == k:
                    all_of.setdefault(w, i)
        order = squares.forward.order
        marked = {"".join(words[order[low] : order[low] + 2 * k]) for k, low, _ in zip(*(x.tolist() for x in squares.vocabulary()), strict=True)}
        assert marked == set(all_of)
        covering = set(zip(*(x.tolist() for x in squares.covering()), strict=True))
        for w, i in all_of.items():  # from a member of the covering set, turning right in steps leads to the leftmost occurrence
            k = len(w) // 2
            j = i
            while j >= 0 and words[j : j + k] == words[j + k : j + 2 * k] and (j, k) not in covering:
                j -= 1
            assert (j, k) in covering


def collapse(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_documents(spark):
    draw = random.Random(3)
    texts = [None, "", " \n ", "one", "x " * 11, "x " * 12, "é\t" * 30, "a b c d e f a b c d e f", " lead a b a b a b a b a b a b a b trail "]
    for _ in range(150):
        words = []
        while len(words) < draw.randint(1, 150):
            unit = [draw.choice(["alpha", "beta", "γ", "d,"]) if draw.random() < 0.7 else str(draw.random()) for _ in range(draw.randint(1, 14))]
            words += unit * draw.randint(1, 4)
        texts.append(draw.choice([" ", "\n", "  "]).join(words))
    texts.append(" ".join(["w1 w2 w3"] * 20_000))
    rows = [(draw.choice([i, 7, None]), t, [1], "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, collapsed string").repartition(3)
    for least in (12, 5, 2):
        got = sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs, least).collect())
        want = []
        for k, t, _, _ in rows:
            words = words_of(t)
            found = brute(words, least) if len(words) < 50_000 else [(0, 60_000, 3)]
            want.append((k or -1, len(words), found, collapse(words, found)))
        assert got == sorted(want)
    assert runs.periodic_runs(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_query_equals_plain(spark):
    got = {r.doc_id: r for r in op13_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    changed = 0
    for doc_id, text in docs:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        found = brute(words, 12)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, found).encode()).hexdigest()
    assert changed > 5
