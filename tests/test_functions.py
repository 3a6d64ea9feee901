import json
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import cleaning, mathx, text, udfs
from corpusloom.sources import paged, records


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'long' if isinstance(v, int) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first().x


def test_identifiers(spark):
    assert one(spark, text.normalize_doi("v"), v=" https://doi.org/10.1234/Zenodo.1") == "10.1234/zenodo.1"
    assert one(spark, text.arxiv_id("v"), v="http://arxiv.org/pdf/1706.03762v5") == "1706.03762"
    assert one(spark, text.arxiv_id("v"), v="arXiv: hep-th/9901001") == "hep-th/9901001"
    assert one(spark, text.openalex_id("v"), v="https://openalex.org/W12?x=1") == "W12"
    assert one(spark, text.publication_year("v"), v="0999-01-01") is None


def test_titles_and_anchor(spark):
    assert one(spark, text.title_spaced("v"), v="  Few-Shot  learning!! ") == "few shot learning"
    assert one(spark, text.title_deleted("v"), v="few-shot") == "fewshot"
    strength = lambda t: one(spark, text.anchor_strength(F.col("t"), F.col("p")), t=t, p="attention is all you need")
    assert [strength(t) for t in ("attention is all you need", "attention is all you need now", "attention is all you need for small models", "why attention is all you need", "other")] == [1.0, 1.0, 0.48, 0.35, 0.0]


def test_numbers(spark):
    assert abs(one(spark, mathx.recency(F.col("d"), "2024-01-31"), d="2023-01-31") - 0.870806922558) < 1e-9
    assert one(spark, mathx.recency(F.col("d"), "2024-01-31"), d="nonsense") == 0
    assert abs(one(spark, mathx.citation_blended(F.col("c"), F.col("d"), 2024, 0.35), c=100, d="2020-01-01") - 0.611279047514) < 1e-9
    assert one(spark, mathx.backoff(F.col("c"), 1.0, 10.0), c=5) == 10.0


def test_tokens(spark):
    assert one(spark, text.tokens_long("v"), v="ab cd efgh") == ["efgh"]
    assert one(spark, text.initials("v"), v="Long Short-Term Memory") == "LSTM"
    assert one(spark, text.sentences("v"), v="One. Two! Three? ") == ["One.", "Two!", "Three?"]
    assert one(spark, text.quiz_answer("v"), v="b) Paris") == "paris"
    assert one(spark, text.strip_code_fences("v"), v="```json\n{}\n```") == "{}"


def test_cleaning(spark):
    assert one(spark, cleaning.clean_text(F.col("v")), v="multi-\nline [1, 2]  text\n\n\n\nend") == "multiline text\n\nend"
    assert one(spark, cleaning.body_lines(F.col("v")), v="a\nb\n7. References\nc") == "a\nb"
    assert one(spark, cleaning.distinct_lines(F.col("v")), v="a\n\nb\na\n\nc") == "a\n\nb\n\nc"
    assert one(spark, cleaning.is_equation(F.col("v")), v="y = a x + b") and not one(spark, cleaning.is_equation(F.col("v")), v="see https://a.b = c")
    assert one(spark, cleaning.is_heading(F.col("v")), v="2.1 Training") and not one(spark, cleaning.is_heading(F.col("v")), v="plain text here")
    assert one(spark, cleaning.variables(F.col("v")), v="α + b = abc") == ["b", "α"]


def test_udfs(spark):
    udfs.register(spark)
    assert spark.sql("select nfkc('ﬁ') as x").first().x == unicodedata.normalize("NFKC", "ﬁ")
    vector = spark.sql("select hash_embedding('t') as x").first().x
    assert len(vector) == 64 and abs(sum(v * v for v in vector) - 1) < 1e-9
    for cut in ('{"a": [1, {"b": "x', '{"a": [1, 2,', '{"a": "q\\"'):
        json.loads(udfs.repaired(cut))
    assert udfs.nearest(3, [1, 5]) == 1 and udfs.nearest(3, []) is None


def test_sources(spark):
    spark.dataSource.register(paged.PagedSource)
    pages = "\n".join(json.dumps({"id": str(i), "title": "" if i == 3 else f"t{i}", "year": 2000 + i}) for i in range(10))
    got = spark.read.format("paged_records").option("pages", pages).option("per_page", 4).option("max_total", 8).load()
    assert sorted((r.id, r.page) for r in got.collect()) == [("0", 1), ("1", 1), ("2", 1), ("4", 2), ("5", 2), ("6", 2), ("7", 2)]
    items = spark.createDataFrame([("https://openalex.org/W1", "T", 2020, None, "10.1/X", list("abcdefghij"), {"world": [1], "hello": [0, 2]}), ("W2", " ", None, None, None, [], None)],
                                  "id string, title string, year int, landing string, doi string, concepts array<string>, index map<string, array<int>>")
    row = records.normalized(items).collect()
    assert len(row) == 1 and row[0].abstract == "hello world hello" and row[0].url == "https://doi.org/10.1/x" and len(row[0].tags) == 8 and row[0].published_date == "2020-01-01"
