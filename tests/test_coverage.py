"""The automaton against ``in``, and keyword coverage against the formulas in plain Python."""

import random
import re

from corpusloom.functions.automaton import term_hits
from corpusloom.operators.coverage import coverage, keyword_ranks
from corpusloom.operators.landmarks import landmarks, topic_keys


def test_term_hits(spark):
    draw = random.Random(1)
    needles = {"".join(draw.choice("abé ") for _ in range(draw.randint(0, 4))) for _ in range(60)} | {"zz"}
    texts = [(k, "".join(draw.choice("abé c") for _ in range(draw.randint(0, 30)))) for k in range(80)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(texts, "id long, body string")
    asked = spark.createDataFrame([(n,) for n in needles] * 2 + [(None,)], "needle string")
    want = sorted((k, n) for k, t in texts for n in needles if t is not None and n in t)
    for most in (1000, 7):
        assert sorted(tuple(r) for r in term_hits(docs, "id", "body", asked, most).collect()) == want
    assert term_hits(docs, "id", "body", asked.limit(0)).collect() == []
    assert term_hits(docs.limit(0), "id", "body", asked).collect() == []


def plain(retrieved, keywords):
    norm = lambda t: re.sub(r"[^a-z0-9 ]", "", t.lower()).strip()
    out = {}
    for topic in {k[0] for k in keywords}:
        rows = sorted(r[1:] for r in retrieved if r[0] == topic)
        row = {"n_retrieved": len(rows), "n_sources": len({s.strip() for r in rows for s in r[2].split(",") if s.strip()})}
        all_found = all_n = 0
        for tier in ("must", "should"):
            mine = [k for t, i, k in keywords if t == topic and i == tier]
            ranks = [next((r[0] for r in rows if norm(k) in norm(r[1])), None) for k in mine]
            found = [r for r in ranks if r]
            row |= {f"{tier}_n": len(mine), f"{tier}_found": len(found), f"{tier}_recall": round(100 * len(found) / len(mine), 1) if mine else 100.0, f"{tier}_mrr": round(sum(1 / r for r in found) / len(mine), 3) if mine else 0.0}
            all_found, all_n = all_found + len(found), all_n + len(mine)
        out[topic] = row | {"total_recall": round(100 * all_found / all_n, 1)}
    return out


def test_coverage(spark):
    titles = ["Attention Is All You Need", "BERT: Pre-training", "Denoising Diffusion", "High-Resolution Image Synthesis", "t5", ""]
    draw = random.Random(2)
    retrieved = [(topic, rank + 1, draw.choice(titles), draw.choice(["arxiv", "openalex", "arxiv, openalex", " ,"])) for topic in (1, 2, 3) for rank in range(draw.randint(3, 6))]
    words = ["attention is all you need", "bert", "T-5", "diffusion", "gpt", "high-resolution", "--"]
    keywords = [(topic, tier, k) for topic in (1, 2, 4) for tier in ("must", "should") for k in draw.sample(words, draw.randint(1, 4)) if not (topic == 2 and tier == "should")]
    r = spark.createDataFrame(retrieved, "topic int, rank int, title string, source string")
    k = spark.createDataFrame(keywords, "topic int, tier string, keyword string")
    got = {x.topic: x.asDict() for x in coverage(r, k).collect()}
    want = plain(retrieved, keywords)
    assert set(got) == set(want)
    for topic, row in want.items():
        assert {c: got[topic][c] for c in row} == row
    assert keyword_ranks(r, k).count() == len(keywords)


def test_landmarks(spark):
    records = [("graph neural networks", 1, "GCN", 1.2), ("transformers", 2, "Attention", 1.5), ("graph", 3, "Graphs", None), ("transformers", 4, "BERT", 1.0)]
    topics = [(1, " Transformers "), (2, "vision transformers today"), (3, "neural"), (4, "graph"), (5, "cooking"), (6, None), (7, "graph neural networks at scale")]
    r = spark.createDataFrame(records, "key string, place int, title string, score double")
    t = spark.createDataFrame(topics, "topic_id int, topic string")
    places: dict = {}
    for key, place, _, _ in records:
        places.setdefault(key, place)
    want = {}
    for k, topic in topics:
        name = (topic or "").lower().strip()
        key = name if name in places else next((x for x in places if name in x or x in name), None)
        if key is not None:
            want[k] = (name, key)
    keys = r.groupBy("key").agg({"place": "min"}).withColumnRenamed("min(place)", "place")
    assert {x.topic_id: (x.name, x.key) for x in topic_keys(t, keys).collect()} == want
    got = sorted((x.topic_id, x.id, x.title, x.citations) for x in landmarks(t, r).collect())
    assert [g for g in got if g[0] == 1] == [(1, "local-transformers-1", "Attention", 4000), (1, "local-transformers-2", "BERT", 3000)]
    assert [g[3] for g in got if g[0] == 4] == [3000]
