"""Small cases of record views, expansion, answer cleaning, limits and corrections."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.functions import answers, cleaning
from corpusloom.operators import expansion, reviews, views
from corpusloom.streaming import limits


def one(spark, column, **values):
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_views(spark):
    assert sorted(one(spark, views.surnames(F.col("a")), a=["Ada Lovelace", " alan  TURING ", "", "Ada Lovelace", "late Entry"])) == ["lovelace", "turing"]
    assert one(spark, views.composite(F.col("c"), F.col("a"), F.col("b")), c=None, a=0.25, b=None) == 0.25
    written = spark.createDataFrame([(1, "A. Smith"), (1, "B"), (2, "smithson"), (3, "S_mith")], "id long, author string")
    assert sorted(r.id for r in views.by_author(written, "author", " SMITH ").collect()) == [1, 2]
    rows = spark.createDataFrame([("s", i) for i in range(7)], "source string, id long")
    assert [(r.page, r.n, r.next_cursor) for r in views.cursor_pages(rows, ["source"], "id", 3, 100, 9).orderBy("page").collect()] == [(0, 3, 2), (1, 3, 5), (2, 1, None)]


def test_expansion(spark):
    assert one(spark, expansion.variants(F.col("q")), q="graph neural network") == ["graph neural network", '"graph neural network"', "deep graph neural network", "graph neural network survey"]
    assert one(spark, expansion.distinct_queries(F.col("q")), q=["a b c d e f g", '"a b c d e f g"', "a b c d e f g h", "x y", "Y, x"]) == ["a b c d e f g", '"a b c d e f g"', "x y"]
    assert one(spark, expansion.focus_term(F.col("q")), q="What is dense retrieval?") == "dense retrieval"
    assert one(spark, expansion.response_mode(F.col("q")), q="how many tables are there") == "count"
    assert one(spark, expansion.metadata_field(F.col("q")), q="who wrote it") == "authors"
    assert one(spark, expansion.after_failure(F.col("q"), F.lit(0.1)), q="sparse attention") == ["general information about sparse attention", "sparse attention overview", "background on sparse attention", "general information about sparse", "sparse overview"]


def test_answers(spark):
    said = "One fine sentence. One fine sentence. Short. Short.\nline\nline"
    assert one(spark, answers.without_repetition(F.col("t")), t=said) == "One fine sentence. Short. Short. line"
    assert one(spark, answers.without_leaks(F.col("t")), t="Answer: yes <s>hidden</s>\n\n\n\nUser: no") == "yes \n\nno"
    assert one(spark, answers.collapsed_double(F.col("t")), t="abab") == "ab" and one(spark, answers.collapsed_double(F.col("t")), t="aba") == "aba"
    assert one(spark, answers.strict_equation(F.col("t")), t="y = a x + b") and not one(spark, answers.strict_equation(F.col("t")), t="see https://a.b = c d")
    assert one(spark, answers.provider_error(F.col("t")), t="HTTP 429") == "rate_limit"
    assert one(spark, cleaning.expand_abbreviations(F.col("t")), t="An LLM of NLP") == "An Large Language Model of Natural Language Processing"


def test_corrections(spark):
    known = F.array(*[F.lit(k) for k in (1, 4)])
    changes = reviews.unknown_references(F.col("t"), known)
    assert one(spark, reviews.corrected(F.col("t"), changes, F.size(changes) > 1), t="See Table 3 and Equation 9.") == "See Table 4 and Equation 4." + reviews.WARNING
    assert one(spark, reviews.corrected(F.col("t"), changes, F.size(changes) > 1), t="See Table 2, table 1.") == "See Table 1, table 1."


def test_limits(spark):
    start = datetime(2024, 1, 1)
    log = [(i, 7, start + timedelta(seconds=20 * i), 30) for i in range(5)]
    events = spark.createDataFrame(log, "event_id long, user_id long, ts timestamp, tokens long")
    got = {r.event_id: (r.tokens_minute, r.allowed, r.reason, r.wait) for r in limits.usage(events, limits.Limits(30, 100, 130, 1000)).collect()}
    assert got[0] == (0, True, None, 0.0) and got[3] == (90, True, "tokens_minute", 0.0)
    assert got[4][1:] == (False, "day", -1.0)
    waits = {r.event_id: r.wait for r in limits.gaps(events, "user_id", 30.0).collect()}
    assert waits == {0: 0.0, 1: 10.0, 2: 10.0, 3: 10.0, 4: 10.0}
    blocked = {r.event_id: r.blocked for r in limits.cooldowns(events, "user_id", F.col("event_id") == 1, F.lit(25), 10, 60).collect()}
    assert blocked == {0: False, 1: False, 2: True, 3: False, 4: False}
