"""Range scans, as-of joins, the chain of caches and similar successes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import expansion as x
from corpusloom.operators.fallback import Times, answer_levels
from corpusloom.operators.scans import asof, scanned


@pytest.mark.parametrize("hot", [False, True])
def test_scanned(spark, hot):
    draw = random.Random(1)
    rows = [("h" if hot and draw.random() < 0.8 else draw.choice(["a", "b", None]), k, draw.choice([None, draw.randint(-9, 9)])) for k in range(600)]
    frame = spark.createDataFrame(rows, "key string, place int, v int").repartition(6)
    got = {r.place: (r.total, r.last, r.high) for r in scanned(frame, "key", ["place"], {"total": F.col("v")}, {"last": F.col("v")}, {"high": F.col("v")}).collect()}
    seen: dict = {}
    for key, k, v in rows:
        total, last, high = seen.get(key, (None, None, None))
        if v is not None:
            total, last, high = (total or 0) + v, v, v if high is None else max(high, v)
        seen[key] = (total, last, high)
        assert got[k] == seen[key]
    assert scanned(frame.limit(0), "key", ["place"], {"total": F.col("v")}).count() == 0


def test_asof(spark):
    draw = random.Random(2)
    left = [(draw.choice([1, 1, 1, 2, None]), draw.randint(0, 40), k, f"l{k}") for k in range(200)]
    right = [(draw.choice([1, 1, 2, 3, None]), draw.randint(0, 40), k, f"r{k}", draw.choice([None, k])) for k in range(120)]
    got = {r.place: (r.name, r.n) for r in asof(spark.createDataFrame(left, "key int, at int, place int, own string"), spark.createDataFrame(right, "key int, at int, place int, name string, n int"), "key", "at", ["name", "n"], "place").collect()}
    for key, at, k, _ in left:
        found = max(((a, p, name, n) for c, a, p, name, n in right if c == key and a <= at), default=None, key=lambda r: r[:2])
        assert got[k] == (found[2:] if found else (None, None))


def test_answer_levels(spark):
    draw = random.Random(3)
    times = Times(memory=50, disk=200, pause=(5, 20), failure=(10, 60))
    log, place = [], 0
    for _ in range(900):
        place += 1
        at = draw.randint(0, 4000) * 1_000_000
        key = draw.choice("abcdefgh")
        kind = draw.choices(["request", "memory", "disk", "refusal"], [6, 1, 2, 1])[0]
        log.append((at, place, kind, key, draw.choice([1, 2, 2, 3]), draw.randint(0, 90), draw.choice(["ok", "refused", "timeout"])))
    asked = spark.createDataFrame([(p, k, a, p, o) for a, p, kind, k, _, _, o in log if kind == "request"], "request int, key string, at long, place int, outcome string")
    writes = spark.createDataFrame([(k, a, p, kind, v) for a, p, kind, k, v, _, _ in log if kind in ("memory", "disk")], "key string, at long, place int, store string, version int")
    refusals = spark.createDataFrame([(k, a, p, float(s)) for a, p, kind, k, _, s, _ in log if kind == "refusal"], "key string, at long, place int, seconds double")
    got = {r.request: r.level for r in answer_levels(asked, writes, refusals, times).collect()}
    memory, disk, failure, pause = {}, {}, {}, 0
    for at, p, kind, key, version, seconds, outcome in sorted(log):
        if kind == "memory":
            memory[key] = at
        elif kind == "disk":
            disk[key] = (at, version)
        elif kind == "refusal":
            failure[key] = at + min(max(seconds, 10), 60) * 1_000_000
            pause = max(pause, at + min(max(seconds, 5), 20) * 1_000_000)
        else:
            then, v = disk.get(key, (0, 3))
            on_disk = v == 1 or (v == 2 and at - then <= 200_000_000)
            if at < pause:
                want = "disk_while_paused" if on_disk else "paused"
            elif key in memory and at - memory[key] <= 50_000_000:
                want = "memory"
            elif on_disk:
                want = "disk"
            elif at < failure.get(key, 0):
                want = "remembered_refusal"
            else:
                want = {"ok": "network", "refused": "refused"}.get(outcome, "error")
            assert got[p] == want
    assert len(set(got.values())) == 8


def test_similar_successes(spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(0, 7)))
    history = [(k, text(), f"e{k}", round(draw.random(), 3)) for k in range(150)]
    asked = [(k, draw.choice([text(), text() + " New", text().upper(), None])) for k in range(60)]
    frame = x.similar_successes(spark.createDataFrame(asked, "id int, query string"), spark.createDataFrame(history, "id int, query string, expansion string, score double"), 3)
    got = sorted((r.id, r.rank, r.expansion) for r in frame.collect())
    want = []
    for k, query in asked:
        mine, found = set((query or "").lower().split()), []
        for other, past, expansion, score in history:
            theirs = set(past.split())
            share = len(mine & theirs) / max(1, len(mine), len(theirs))
            if k != other and share > 0.5:
                found.append((-round(score * share, 6), other, expansion))
        want += [(k, i + 1, e) for i, (_, _, e) in enumerate(sorted(found)[:3])]
    assert got == sorted(want) and len(want) > 30
    shown = spark.createDataFrame([(1, 0.1, True), (1, 0.4, False), (1, 0.9, False), (2, 0.1, True), (3, 0.1, True), (4, 0.1, False)], "a int, s double, k boolean")
    assert [r[0] for r in shown.select(x.chosen_strategy(F.col("a"), F.col("s"), F.col("k"))).collect()] == ["multi_strategy", "synonym_injection", "question_reformulation", "specificity_reduction", "similar_successes", "context_addition"]
