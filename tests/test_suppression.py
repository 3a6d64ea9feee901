"""Greedy suppression against a loop over the rows in order."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators.suppression import compared, suppressed, suppressed_list


def plain(rows):
    kept = {}
    for key, place, text, confidence in sorted(rows, key=lambda r: (-r[3], r[1])):
        norm = re.sub(r"\s+", "", (text or "").lower())
        mine = kept.setdefault(key, [])
        like = lambda a, b: a == b or (len(a) > 10 and len(b) > 10 and sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) > 0.9)
        if not any(like(norm, s) for _, s in mine):
            mine.append((place, norm))
    return sorted((k, p) for k, v in kept.items() for p, _ in v)


def test_suppressed_equals_the_loop(spark):
    draw = random.Random(7)
    rows = []
    for key in range(12):
        base = ["".join(draw.choice("abc= +") for _ in range(draw.choice([8, 11, 12, 20, 45, 130, 300]))) for _ in range(4)]
        for place in range(40):
            text = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 2, 5, 12])):
                text[draw.randrange(len(text))] = draw.choice("abcXYZ")
            text = "".join(text) + draw.choice(["", "", "z", "zz zz"])
            rows.append((key, place, draw.choice([text, text, text.upper(), None if place % 13 == 0 else text]), draw.choice([0.7, 0.95])))
    # a chain in which each is like the next only: the first and third stay
    chain = ["a" * 40, "a" * 37 + "b" * 3, "a" * 34 + "b" * 6, "a" * 31 + "b" * 9]
    rows += [(99, i, t, 0.5) for i, t in enumerate(chain)]
    frame = spark.createDataFrame(rows, "page int, place int, body string, confidence double").repartition(5)
    got = sorted((r.page, r.place) for r in suppressed(frame, ["page"], "body", "confidence", "place").collect())
    assert got == plain(rows)
    assert [p for k, p in got if k == 99] == [0, 2]
    assert suppressed(frame.limit(0), ["page"], "body", "confidence", "place").collect() == []


def test_suppressed_list_equals_the_loop(spark):
    draw = random.Random(8)
    rows = []
    for key in range(12):
        base = ["".join(draw.choice("abc= +") for _ in range(draw.choice([8, 11, 20, 45, 300]))) for _ in range(4)]
        for place in range(40):
            text = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 2, 5, 12])):
                text[draw.randrange(len(text))] = draw.choice("abcXYZ")
            rows.append((key, place, None if place % 13 == 0 else "".join(text) + draw.choice(["", "z", "zz zz"]), draw.choice([0.7, 0.95])))
    frame = spark.createDataFrame(rows, "page int, place int, body string, confidence double").repartition(5)
    held = frame.groupBy("page").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("less"), "place", F.coalesce("body", F.lit("")).alias("body")))).alias("held")).repartition(3)
    found = held.select("page", F.transform(suppressed_list(F.transform("held", lambda c: compared(c["body"]))), lambda n: F.get("held", n)["place"]).alias("kept"))
    assert sorted((r.page, p) for r in found.collect() for p in r.kept) == plain(rows)


def test_equation_dedup_shuffles_nothing(spark, tmp_path):
    from corpusloom.plans import layout

    texts = [(1, "x = 1\nx=1\nplain words of a line\nplain words of a line."), (2, None), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = layout.equation_dedup(spark, str(tmp_path))
    assert sorted((r.id, r.place, r.confidence) for r in found.collect()) == [(1, 1, 0.95), (1, 4, 0.7), (3, 0, 0.7)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
