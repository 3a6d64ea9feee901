import datetime

from pyspark.sql import functions as F

from corpusloom.functions.udfs import hash_embedding
from corpusloom.operators import bibliometrics as b
from corpusloom.operators import chunking as c
from corpusloom.operators import evidence as e
from corpusloom.operators import graphs as g
from corpusloom.operators import querying as q
from corpusloom.operators import resolution as res
from corpusloom.operators import retrieval as r
from corpusloom.sources import records
from corpusloom.streaming import limiter


def test_author_impact(spark):
    rows = spark.createDataFrame([("Alice Smith", 1000, 0.8), ("Alice Smith", 100, 0.4), ("Bob Lee", 100, 0.4)], "author string, citations long, semantic double")
    got = [(x.author, x.paper_count, x.citations, x.impact_score) for x in b.author_impact(rows).collect()]
    assert got == [("Alice Smith", 2, 1100, 17.5), ("Bob Lee", 1, 100, 5.5)]


def test_trend(spark):
    assert b.trend(spark.createDataFrame([("2023-01", 1), ("2023-04", 2)], "month string, n long")).first().trend == "Rising"
    assert b.trend(spark.createDataFrame([("2023-01", 1)], "month string, n long")).first().trend == "Stable"


def test_subtopics(spark):
    row = spark.createDataFrame([("a vit for image classification", ), ("plain", )], "t string").select(b.subtopics(F.col("t"), "").alias("x"), b.subtopics(F.col("t"), "transformers").alias("y")).collect()
    assert row[0].x == ["Vision Transformers"] and row[1].x == [] and row[1].y == ["General Transformers"]


def test_scope(spark):
    cases = [("cs.lg", [], ["arxiv"], True), ("q-bio.nc", ["machine learning"], ["arxiv"], False), ("cs.lg", ["computer science", "cell biology"], ["arxiv", "openalex"], False),
             (None, ["computer science"], ["openalex"], True), (None, ["genetics"], ["openalex"], False), (None, ["materials science"], ["openalex"], False), (None, ["transformers"], ["openalex"], True)]
    got = spark.createDataFrame(cases, "c string, t array<string>, s array<string>, want boolean").select("want", q.in_scope(F.col("c"), F.col("t"), F.col("s")).alias("x")).collect()
    assert all(x.want == x.x for x in got)


def test_bm25_and_rrf(spark):
    terms = spark.createDataFrame([(1, t, 1) for t in "transformer attention neural network".split()] + [(2, t, 1) for t in "cooking pasta recipes".split()], "id long, term string, tf long")
    asked = spark.createDataFrame([(0, "transformer", 1), (0, "attention", 1)], "query_id long, term string, qf long")
    got = r.bm25(terms, asked).collect()
    assert [(x.id, round(x.score, 5)) for x in got] == [(1, 1.30256)]
    lists = [spark.createDataFrame(x, "query_id long, id string, rank int") for x in ([(0, "a", 1), (0, "b", 2)], [(0, "b", 1), (0, "a", 2), (0, "c", 3)])]
    assert [(x.id, x.score) for x in r.rrf(lists, 3).orderBy("rank").collect()] == [("a", 0.032522475), ("b", 0.032522475), ("c", 0.015873016)]
    pool = r.min_max(spark.createDataFrame([(0, 5.0), (0, 5.0), (1, 0.0), (1, 10.0)], "query_id long, score double"))
    assert sorted((x.query_id, round(x.scaled, 6)) for x in pool.collect()) == [(0, 0.5), (0, 0.5), (1, 0.0), (1, 1.0)]


def test_vector_topk(spark):
    vectors = spark.createDataFrame([(i, hash_embedding(str(i))) for i in range(6)], "id long, embedding array<double>")
    best = r.vector_topk(vectors, vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 1).collect()
    assert all(x.id == x.query_id and x.score == 1.0 for x in best)


def test_resolution(spark):
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(["a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i z q", "x y", "y x", ""])], "id long, tokens array<string>")
    rows = rows.withColumn("tokens", F.filter("tokens", lambda t: t != "")).withColumn("token_key", F.nullif(F.array_join(F.array_sort("tokens"), " "), F.lit("")))
    links = res.key_links(rows, "token_key").union(res.title_links(rows, "tokens", 0.75))
    assert {x.id: x.cluster for x in res.clusters(rows, links).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_alias_map_and_cleaning(spark):
    names = ["Recurrent Neural Network", "RNN", "Long Short-Term Memory (LSTM)", "LSTM", "Transformer", "BLEU", "", "28.4"]
    ents = spark.createDataFrame([(i, n, "Model") for i, n in enumerate(names)], "pos int, name string, type string")
    aliases = g.aliases(ents)
    found = {x["alias"]: x.canonical for x in aliases.collect()}
    assert found["rnn"] == "Recurrent Neural Network" and found["lstm"] == "Long Short-Term Memory"
    assert {x.name for x in g.canonical_entities(ents, aliases).collect()} == {"Recurrent Neural Network", "Long Short-Term Memory", "Transformer", "BLEU"}
    rels = spark.createDataFrame([(0, "RNN", "uses", "LSTM", "e1"), (1, "rnn", "USES", "LSTM", "e2"), (2, "", "x", "LSTM", "e3"), (3, "Transformer", None, "BLEU", "e4")], "pos int, head string, relation string, tail string, evidence string")
    got = {(x.head, x.relation, x.tail, x.evidence) for x in g.canonical_relations(rels, aliases).collect()}
    assert got == {("Recurrent Neural Network", "USES", "Long Short-Term Memory", "e1"), ("Transformer", "RELATED_TO", "BLEU", "e4")}


def test_graph(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("Orphan",)], "id string")
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "cc"), ("cc", "R", "dd"), ("dd", "R", "ee")], "src string, rel string, dst string")
    assert {x.id for x in g.incident(nodes, edges).collect()} == {"A", "B"}
    seeds = spark.createDataFrame([("A",)], "seed string")
    assert [(x.src, x.dst) for x in g.two_hops(edges, seeds).collect()] == [("a", "b"), ("b", "cc")]
    kept = spark.createDataFrame([(x,) for x in ("28.4", "100", "", "A", "  ", "L2.4 regularization", "BLEU-4")], "n string").filter(g.keep_node(F.col("n"))).collect()
    assert {x.n for x in kept} == {"L2.4 regularization", "BLEU-4"}
    score = spark.createDataFrame([("transformer attention model", "the transformer attention mechanism")], "q string, c string").select(
        F.round(g.overlap_rerank(F.col("q"), F.col("c"), F.lit(0.0), F.lit(False)), 2).alias("v"), F.round(g.overlap_rerank(F.col("q"), F.col("c"), F.lit(0.0), F.lit(True)), 2).alias("g")).first()
    assert (score.v, score.g) == (0.34, 0.39)


def test_chunkers(spark):
    parts = c.boundary_chunks("abc. " * 4000, 8000, 500)
    assert parts[-1][1] == 20000 and all(b - a <= 8000 for a, b, _ in parts)
    docs = spark.createDataFrame([(1, "p" * 200 + "\n\n" + "q" * 200), (2, ""), (3, None)], "id long, text string")
    assert [(x.id, x.chunk_no) for x in c.semantic(docs).collect()] == [(1, 0)]
    assert c.by_boundary(docs).filter("id = 1").count() == 1


def test_signals(spark):
    rows = spark.createDataFrame([(1, "The code is released."), (1, "It does not report the optimizer."), (2, "No code."), (2, "batch size 8")], "id long, sentence string")
    assert sorted((x.id, x.grp) for x in e.signal_groups(rows, "id", e.REPRO_SIGNALS).collect()) == [(1, "release"), (2, "hyperparameters")]


def test_limiter_and_cache(spark):
    log, answers = [], []
    for at, tokens in [(0, 10), (1, 10), (2, 100), (60, 10), (61.5, 10)]:
        fits, log = limiter.decide(log, at, tokens, requests=4, limit=60)
        answers.append(fits)
    assert answers == [True, True, False, True, True]
    day = lambda h: datetime.datetime(2024, 1, 1, h)
    entries = spark.createDataFrame([("a", day(1), 1), ("a", day(5), 2), ("b", day(6), 3), ("c", day(0), 4)], "key string, ts timestamp, seq int")
    assert [(x.key, x.seq) for x in records.cache_live(entries, "2024-01-01 07:00:00", 6.5 * 3600, 5).collect()] == [("b", 3), ("a", 2)]


def test_title_links_equal_all_pairs(spark):
    import random

    draw = random.Random(11)
    base = [[f"w{draw.randrange(60)}" for _ in range(n)] for n in (1, 2, 8, 9, 17, 30, 60) for _ in range(4)]
    sets = [sorted({w if draw.random() > 0.03 else f"x{draw.randrange(9)}" for w in draw.choice(base)}) for _ in range(150)] + [[]]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    first = {}
    for i, words in enumerate(sets):
        first.setdefault(tuple(words), i)
    for threshold in (0.75, 0.88):
        want = sorted((i, j) for a, i in first.items() for b, j in first.items() if i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold)
        assert sorted(map(tuple, res.title_links(frame, "tokens", threshold).collect())) == want and want


def test_dedup_components_reads_the_texts_once(spark, tmp_path):
    from corpusloom.plans import records

    texts = [(1, "A fine title\nbody"), (2, "a fine Title!\nother"), (3, "More\nbody"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    found = records.dedup_components(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert "documents" not in found._jdf.queryExecution().executedPlan().toString()
