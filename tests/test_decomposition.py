"""Questions with parts against ``re`` and the steps of each type, and batches against the loop over priorities."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import answers as a

QUESTIONS = [
    "Compare BERT and GPT models", "what is the difference between table 1 and table 2?", "relationship between loss and accuracy", "adam versus sgd", "adam vs. sgd now", "How do transformers differ from RNNs",
    "Show table 3 and equation 4", "fig 2 and tbl 7", "equation 1 and eq 2", "results of table 5", "explain it using equation 9", "load it, then plot it", "first read, next write", "train and also test", "speed as well as size",
    "plain question", "", None, "  Compare A with B  ",
]


def plain(query):
    low = query.lower().strip()
    for pattern, kind, steps in a.PARTED:
        if m := re.search(pattern, low):
            parts = {"q": query, "a": m.group(1).strip(), "b": m.group(2).strip() if m.re.groups > 1 else ""}
            return [(kind, i, t.format(**parts), k, p, d) for i, (t, k, p, d) in enumerate(steps)]
    return [("simple", 0, query, "simple", 1, "")]


def test_decomposed(spark):
    frame = spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, query string")
    got = {}
    for r in sorted(a.decomposed(frame, "id", "query").collect(), key=lambda r: (r.id, r.step)):
        got.setdefault(r.id, []).append((r.type, r.step, r.sub_query, r.kind, r.priority, r.depends))
    for k, query in enumerate(QUESTIONS):
        assert got[k] == (plain(query) if query is not None else [("simple", 0, None, "simple", 1, "")])
    assert {v[0][0] for v in got.values()} == {t for _, t, _ in a.PARTED} | {"simple"}


def test_execution_batches(spark):
    draw = random.Random(6)
    rows = [(k, i, draw.randint(1, 3), ",".join(str(d) for d in sorted(draw.sample(range(7), draw.choice([0, 0, 1, 2]))))) for k in range(60) for i in range(draw.randint(1, 6))]
    frame = spark.createDataFrame(rows, "id int, step int, priority int, depends string").repartition(3)
    got = {(r.id, r.step): r.batch for r in a.execution_batches(frame, "id").collect()}
    for k in range(60):
        mine = [r for r in rows if r[0] == k]
        done, batches = set(), []
        for priority in (1, 2, 3):
            batch = []
            for _, i, p, depends in mine:
                if p == priority and all(int(d) in done for d in depends.split(",") if d):
                    batch.append(i)
                    done.add(i)
            if batch:
                batches.append(batch)
        for _, i, _, _ in mine:
            assert got[k, i] == next((n for n, b in enumerate(batches) if i in b), None)
    shown = spark.createDataFrame([("relation",), ("versus",), (None,)], "t string")
    assert [r[0] for r in shown.select(a.uses_fusion(F.col("t"))).collect()] == [True, False, False]
