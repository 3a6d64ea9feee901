"""Rule extraction on sentences, and its way through the graph operators."""

from corpusloom.operators import extraction as ex
from corpusloom.operators import graphs as g


def test_entities_and_relations(spark):
    rows = [(1, 0, "The Recurrent Neural Network (RNN) uses the Attention."), (1, 1, "RNN quickly improves BLEU, while Élan Vital is a concept"), (2, 0, "What is it"), (2, 1, None), (2, 2, "GLUE was used; the Deep Model outperforms the T5-Base model"), (3, 0, "")]
    frame = spark.createDataFrame(rows, "id long, pos long, sentence string")
    found = sorted((r.pos.id, r.pos.pos, r.pos.k, r.name, r.type) for r in ex.entities(frame).collect())
    assert [(i, p, n, t) for i, p, _, n, t in found] == [
        (1, 0, "The Recurrent Neural Network", "Model"), (1, 0, "RNN", "Concept"), (1, 0, "Attention", "Method"), (1, 1, "RNN", "Concept"), (1, 1, "BLEU", "Metric"), (1, 1, "Élan Vital", "Concept"),
        (2, 2, "GLUE", "Dataset"), (2, 2, "Deep Model", "Model"), (2, 2, "T5-Base", "Concept"),
    ]
    made = sorted((r.pos.id, r.pos.pos, r.head, r.head_type, r.relation, r.tail, r.tail_type) for r in ex.relations(frame).collect())
    assert made == [
        (1, 1, "RNN", "Concept", "IMPROVES", "BLEU", "Metric"), (1, 1, "Élan Vital", "Concept", "IS", "concept", "Concept"),
        (2, 2, "Deep Model", "Model", "OUTPERFORMS", "T5-Base", "Concept"),
    ]


def test_extraction_feeds_the_graph(spark):
    rows = [(1, 0, "Recurrent Neural Network is a model"), (2, 0, "RNN is a model"), (3, 0, "An RNN extends Perceptron")]
    frame = spark.createDataFrame(rows, "id long, pos long, sentence string")
    names = ex.entities(frame)
    aliases = g.aliases(names)
    assert {(r.alias, r.canonical) for r in aliases.collect()} == {("rnn", "Recurrent Neural Network")}
    made = {(r.head, r.relation, r.tail) for r in g.canonical_relations(ex.relations(frame), aliases).collect()}
    assert made == {("Recurrent Neural Network", "IS", "model"), ("An RNN", "EXTENDS", "Perceptron")}  # a run with another word is another name


def test_end_mentions_and_first_relations_give_the_same_graph(spark):
    said = ["Recurrent Neural Network is a model", "RNN is a model", "Rapid Noise Net uses Perceptron", "RNN is a model", "(RNN is a model", "Deep (RNN) uses GLUE and so Deep is SQUAD; Rapid Noise Net is RNN"]
    frame = spark.createDataFrame([(i, p, s) for i in range(3) for p, s in enumerate(said[i:])], "id long, pos long, sentence string")
    every, ends = ex.entities(frame), ex.end_mentions(frame)
    assert ends.count() < every.count()
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(g.aliases(ends)) == rows(g.aliases(every))
    assert rows(g.canonical_entities(ends, g.aliases(ends))) == rows(g.canonical_entities(every, g.aliases(every)))
    assert rows(g.canonical_relations(ex.first_relations(frame), g.aliases(ends))) == rows(g.canonical_relations(ex.relations(frame), g.aliases(every)))


def test_text_incident_reads_the_texts_for_names_once(spark, tmp_path):
    from corpusloom.plans import extraction

    spark.createDataFrame([(1, "Recurrent Neural Network is a model. RNN uses GLUE."), (2, None)], "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    found = extraction.text_incident(spark, str(tmp_path))
    assert sorted((r.id, r.type) for r in found.collect()) == [("GLUE", "Dataset"), ("Recurrent Neural Network", "Concept"), ("Recurrent Neural Network", "Model")]
    assert "documents" not in found._jdf.queryExecution().executedPlan().toString()  # names and ends are tables by then
