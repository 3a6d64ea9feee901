import random

import numpy as np
import pytest

from corpusloom.llm import toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    draw = random.Random(1)
    words, stems = ["idiot", "moron", "clown", "worthless", "bad"], ["lowei", "chlla"]
    automaton = toxicity.build_automaton(words, stems)
    tried = []
    for _ in range(3000):
        w = list(draw.choice(words + stems))
        for _ in range(draw.randint(0, 3)):
            i, kind = draw.randint(0, len(w)), draw.randint(0, 2)
            w[i : i + (kind > 0)] = [] if kind == 2 else [draw.choice("abcdehilmnorstw")]
        if w:
            tried.append("".join(w))
    data = np.frombuffer(" ".join(tried).encode(), np.uint8)
    starts, ends, _ = toxicity.tb.words(data, np.array([0, len(data)]), toxicity.MEMBER)
    exact, fuzzy = toxicity.run(automaton, data, starts, ends)
    for w, e, z in zip(tried, exact, fuzzy, strict=True):
        plain = w in words or any(w.startswith(s) for s in stems)
        assert e == plain
        assert z == (not plain and any(len(t) >= toxicity.MIN_FUZZY and edits(w, t) <= 1 for t in words))


def rows(n=600):
    draw = random.Random(2)
    fill = ["stone", "river", "green", "walk", "light", "paper", "quiet", "table"]
    out, labels = [], []
    for i in range(n):
        text = [draw.choice(fill) for _ in range(30)]
        bad = i % 3 == 0
        for _ in range(3 * bad):
            text[draw.randrange(30)] = draw.choice(["grubwort", "snivelork"])
        out.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return out, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = rows()
    return toxicity.train(toxicity.labelled_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))


def test_held_out_accuracy_and_misspelling(spark, model):
    docs, labels = rows()
    extra = [(1000, "river grubwert stone snivelorc walk grubworrt"), (1001, None), (1002, ""), (1003, "river " * 50_000), (1003, "river " * 50_000)]
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(docs + extra, "doc_id long, text string"), model).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert got[1000].predicted == 1 and got[1001].predicted == 0
    assert got[1001].score == got[1002].score
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, 7), (None, None, None, None)], "doc_id long, text string, score int, label int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_rows(docs, none))
    assert [r.score for r in toxicity.scored(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(docs.limit(0), model).count() == 0


def test_stems_and_rare_terms_are_matched_misspelled(spark):
    draw = random.Random(3)
    fill = ["stone", "river", "green", "walk", "light", "paper", "quiet", "table"]
    cues = ["grubwort", "grubwort", "grubwort", "grubwort", "grubwort", "grubwort", "grubwort", "grubwort", "grubwort", "zanthorpe"]
    ends = ["ing", "ed", "er", "ish", "ly"]
    docs, labels = [], []
    for i in range(1500):
        text = [draw.choice(fill) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            text[draw.randrange(30)] = draw.choice(cues) if draw.random() < 0.5 else "snivel" + draw.choice(ends)
        elif i % 3 == 1:
            text[draw.randrange(30)] = "grubworm"
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(toxicity.labelled_rows(frame, spark.createDataFrame(labels, "doc_id long, toxic int")))
    tried = ["zanthorpe", "zanthorqe", "snivelling", "snivvel", "znivelish", "snevelerling", "grubworrt", "grubworm", "stone"]
    data = np.frombuffer(" ".join(tried).encode(), np.uint8)
    starts, ends_, _ = toxicity.tb.words(data, np.array([0, len(data)]), toxicity.MEMBER)
    exact, fuzzy = model.matcher.hits(data, starts, ends_)
    assert exact.tolist() == [True, False, True, True, False, False, False, False, False]
    assert fuzzy.tolist() == [False, True, False, False, True, True, True, False, False]


def test_lexicon_keeps_every_term(spark):
    names = ["".join(random.Random(k).choices("bcdfgklmnprstvz", k=9)) for k in range(700)]
    rows = [(f"{w} walk{i}", 1) for w in names for i in range(3)] + [(f"walk{i} river", 0) for i in range(40)]
    words, stems = toxicity.learned_terms(spark.createDataFrame(rows, "text string, label int"))
    assert set(names) <= set(words)
    matcher = toxicity.Matcher(toxicity.build_automata(words, stems), np.zeros(0, np.uint64))
    assert len(matcher.automata) > 1
    data = np.frombuffer(" ".join([*names, *[w[:4] + "x" + w[5:] for w in names]]).encode(), np.uint8)
    starts, ends, _ = toxicity.tb.words(data, np.array([0, len(data)]), toxicity.MEMBER)
    exact, fuzzy = matcher.hits(data, starts, ends)
    assert exact[:700].all() and (exact | fuzzy)[700:].all()
