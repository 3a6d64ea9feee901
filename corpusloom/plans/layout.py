"""Layout queries: documents set as pages of words, and web pages as blocks.

The tables hold no boxes. Documents are set in a fixed pitch: 3 points a character, 160
characters and 12 points a line, 60 lines a page. Lines with cell bars are tables and
words without a letter are what is drawn. A web page's tags give its blocks in order;
hosts are documents, and lists tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import latex
from corpusloom.operators import layout as lay
from corpusloom.operators.suppression import compared, suppressed_list
from corpusloom.sources.tables import load

WIDTH, HEIGHT = 552, 792
#: Texts that are set at once.
SLICE = 64


WORDS = "id long, page long, line int, pos int, text string, bars boolean, x0 double, y0 double, x1 double, y1 double"
LETTER = re.compile("[A-Za-z]")


def word_boxes(body: str, drawn: bool) -> Iterator[tuple]:
    """(page, line, pos, word, bars, x0, y0, x1, y1) of a text's words: of lines with cell bars, or of what is drawn, all without an ASCII letter."""
    first = 0
    for line, whole in enumerate(body.split("\n")):
        bars, at = " | " in whole, 0
        if bars or drawn:
            for pos, word in enumerate(whole.split(" ")):
                if word and not (drawn and LETTER.search(word)):
                    row, x0 = first + at // 160, 36.0 + 3 * (at % 160)
                    y0 = 36.0 + 12 * (row % 60)
                    yield row // 60, line, pos, word, bars, x0, y0, x0 + 3 * len(word), y0 + 10
                at += len(word) + 1
        first += len(whole) // 160 + 1


def set_words(spark: SparkSession, sf_dir: str, drawn: bool = False) -> DataFrame:
    """(id, page, line, pos, text, bars, x0, y0, x1, y1): each word of lines with cell bars, or each word that is drawn, with its box; set where the text is read."""
    kept = None if drawn else F.contains("text", F.lit(" | "))
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text").filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WORDS.split(", ")]
        kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), *[pa.float64()] * 4), strict=True))
        for whole in batches:
            for start in range(0, len(whole), SLICE):
                part = whole.slice(start, SLICE)
                rows = [(i, *box) for i, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for box in word_boxes(body, drawn)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    found = (texts if kept is None else texts.filter(kept)).mapInArrow(run, WORDS)
    return found.filter(~F.col("text").rlike(r"\p{L}")) if drawn else found


def bar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = set_words(spark, sf_dir).filter("text <> '|'")
    return cells.select("id", "page", (F.col("line") * 100_000 + F.col("pos")).alias("pos"), "text", "x0", "x1", F.col("y0").alias("top"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each page's table, found from the places of the words alone."""
    return lay.table_cells(bar_words(spark, sf_dir), ["id", "page"])


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lay.table_markdown(table_cells(spark, sf_dir), ["id", "page"])
    return made.select("id", "page", F.md5("markdown").alias("markdown_md5"), F.length("markdown").cast("long").alias("size"))


def set_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, id, caption, box) of the part of each line with cell bars that stands on one page."""
    lines = set_words(spark, sf_dir).groupBy("id", "page", "line")
    return lines.agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("caption"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = set_lines(spark, sf_dir)
    named = captions.select(F.col("id").alias("doc"), "page", F.col("line").alias("id"), "x0", "y0", "x1", "y1")
    drawn = set_words(spark, sf_dir, drawn=True).select(F.col("id").alias("doc"), "page", (F.col("line") * 100_000 + F.col("pos")).alias("id"), "x0", "y0", "x1", "y1")
    pages = named.select("doc", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")).distinct()
    return lay.figure_crops(named, drawn, pages, ["doc", "page"])


def figure_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of what is drawn above or below each line with cell bars."""
    return crops(spark, sf_dir).withColumnRenamed("id", "line")


def crop_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of a document with cell bars, the crop of that document with the same numbers, or its first."""
    captions = set_lines(spark, sf_dir).select(F.col("id").alias("page"), F.col("line").alias("id"), "caption", F.col("page").alias("sheet"))
    made = crops(spark, sf_dir).select(F.col("doc").alias("page"), F.col("page").alias("sheet"), "id")
    held = made.join(captions, ["page", "sheet", "id"]).select("page", F.struct("sheet", "id").alias("id"), "caption")
    asked = captions.select("page", F.struct(F.col("page").alias("doc"), F.col("sheet"), F.col("id")).alias("id"), "caption")
    found = lay.crop_matches(asked, held)
    return found.select("id.doc", "id.sheet", F.col("id.id").alias("line"), F.col("crop_id.sheet").alias("crop_sheet"), F.col("crop_id.id").alias("crop_line"))


BLOCK = '<(?:h1|ul|p|b|footer)>[^<]*|<a [^>]*>[^<]*|<div class="ad">[^<]*'


def web_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/:?#]+)", 1).alias("doc"), F.col("page_id").alias("page"), F.regexp_extract_all("html", F.lit(BLOCK), F.lit(0)).alias("all"))
    tags = pages.select("doc", "page", F.posexplode("all").alias("block", "tag"))
    kind = F.when(F.startswith("tag", F.lit("<h1")), "heading").when(F.startswith("tag", F.lit("<ul")), "table").when(F.startswith("tag", F.lit("<div")), "image").otherwise("text")
    body = tags.select("doc", "page", "block", kind.alias("kind"), F.regexp_replace("tag", "^<[^>]*>", "").alias("text"))
    y0 = (F.col("block") * 20).cast("double")
    return body.select("*", F.lit(36.0).alias("x0"), y0.alias("y0"), (36.0 + 3 * F.length("text")).alias("x1"), (y0 + 16).alias("y1"))


def element_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lay.element_scan(web_blocks(spark, sf_dir))
    return found.select("doc", "page", "block", "element", "number", F.md5("section").alias("section_md5"), F.md5("text").alias("text_md5"), "x1", "y0")


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each image and heading among all of the corpus, in order of pages."""
    every = web_blocks(spark, sf_dir).withColumn("all", F.lit(0))
    counted = lay.numbered(every, "all", ["page", "block"], {"image_no": F.col("kind") == "image", "heading_no": F.col("kind") == "heading"})
    return counted.filter(F.col("kind").isin("image", "heading")).select("page", "block", "kind", "image_no", "heading_no")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, held) with the list of (confidence, place, body), the surest first, of each document: the lines of up to 300 characters, once by a reader that takes all and, with a digit or sign, once by a stricter one."""
    read = lambda confidence, shift: F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.lit(confidence).alias("confidence"), (i * 2 + shift).alias("place"), line.alias("body")))
    strict = F.filter(read(0.95, 1), lambda c: c["body"].rlike("[0-9%=|]"))
    both = F.filter(F.concat(strict, read(0.7, 0)), lambda c: F.length(c["body"]) <= 300)
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), both.alias("held"))


def equation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that no surer or earlier kept one is like."""
    held = candidates(spark, sf_dir)
    kept = held.select("id", "held", F.explode(suppressed_list(F.transform("held", lambda c: compared(c["body"])))).alias("n"))
    one = kept.select("id", F.get("held", F.col("n")).alias("c"))
    return one.select("id", "c.place", "c.confidence", F.md5("c.body").alias("body_md5"))


def document_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between double dollar signs in each document, made fit for display, with its brackets balanced."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = latex.formulas(docs).filter("block")
    return found.select("id", "k", F.md5("latex").alias("latex_md5"), F.md5(latex.for_display(F.col("latex"))).alias("display_md5"), F.md5(latex.balanced(F.col("latex"))).alias("balanced_md5"))


def range_join_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on one page that meet: page by brand, sides by key, size and price; every pair once."""
    x0, y0 = F.col("p_partkey") % 100, F.col("p_size") * 10
    box = load(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") % 5).alias("x1"), (y0 + 15).alias("y1"))
    met = lay.equal_box_pairs(box, box, ["p_brand"], 16)
    return met.filter("id < r_id").select("id", F.col("r_id").alias("b_id"))


QUERIES = {"table_cells": table_cells, "table_markdown": table_markdown, "figure_crops": figure_crops, "crop_matches": crop_matches, "element_scan": element_scan, "page_numbers": page_numbers, "equation_dedup": equation_dedup, "document_formulas": document_formulas, "range_join_bbox": range_join_bbox}

SET_SQL = """tx AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT id, unnest(ls) AS body, unnest(range(0, len(ls))) AS line FROM tx),
ln AS (SELECT *, coalesce(sum(length(body) // 160 + 1) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM l0),
w0 AS (SELECT id, line, first, contains(body, ' | ') AS bars, unnest(string_split(body, ' ')) AS text, unnest(range(0, len(string_split(body, ' ')))) AS pos FROM ln),
w1 AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM w0),
w2 AS (SELECT *, first + spot // 160 AS row FROM w1 WHERE text <> ''),
words AS (SELECT id, CAST(row // 60 AS BIGINT) AS page, line, pos, text, bars, CAST(36 + 3 * (spot % 160) AS DOUBLE) AS x0, CAST(36 + 12 * (row % 60) AS DOUBLE) AS y0, CAST(36 + 3 * (spot % 160) + 3 * length(text) AS DOUBLE) AS x1, CAST(46 + 12 * (row % 60) AS DOUBLE) AS y1 FROM w2)"""
COUNT = "len(regexp_extract_all({0}, '{1}'))"
CELLS_SQL = f"""{SET_SQL},
b0 AS (SELECT id, page, line * 100000 + pos AS pos, text, x0, x1, y0 AS top FROM words WHERE bars AND text <> '|'),
b1 AS (SELECT *, CASE WHEN abs(top - lag(top) OVER o) > 8 THEN 1 ELSE 0 END AS fresh FROM b0 WINDOW o AS (PARTITION BY id, page ORDER BY round_even(top / 5, 0) * 5, x0, pos)),
b2 AS (SELECT *, sum(fresh) OVER (PARTITION BY id, page ORDER BY round_even(top / 5, 0) * 5, x0, pos ROWS UNBOUNDED PRECEDING) AS row FROM b1),
r0 AS (SELECT id, page, row, string_agg(text, '' ORDER BY x0, pos) AS j, count(*) AS n FROM b2 GROUP BY ALL),
r1 AS (SELECT *, (n = 1 AND length(j) > 15 AND {COUNT.format('j', '\\p{L}')} / length(j) > 0.8 AND {COUNT.format('j', '\\p{Nd}')} < 3) OR (length(j) > 60 AND {COUNT.format('j', '\\p{Nd}')} = 0 AND {COUNT.format('j', '[.\\-/+*%]')} < 2) AS prose FROM r0),
r2 AS (SELECT *, min(CASE WHEN NOT prose THEN row END) OVER (PARTITION BY id, page) AS begin_row FROM r1),
r3 AS (SELECT *, min(CASE WHEN prose AND row > begin_row THEN row END) OVER (PARTITION BY id, page) AS stop_row FROM r2),
k AS (SELECT b2.* FROM b2 JOIN r3 USING (id, page, row) WHERE NOT prose AND (stop_row IS NULL OR row < stop_row)),
g0 AS (SELECT *, max(x1) OVER (PARTITION BY id, page, row ORDER BY x0, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
g1 AS (SELECT id, page, row, count(*) AS n, coalesce(list((reach + x0) / 2 ORDER BY x0, pos) FILTER (x0 - reach >= 4), []) AS splits FROM g0 GROUP BY ALL),
g2 AS (SELECT id, page, count(*) AS n_rows, first(splits ORDER BY n DESC, row) AS densest, list_sort(list_distinct(flatten(list(list_transform(splits, lambda s: round_even(s / 2, 0) * 2))))) AS anywhere FROM g1 GROUP BY ALL),
g3 AS (SELECT id, page, CASE WHEN len(densest) > 0 THEN densest ELSE anywhere END AS splits FROM g2 WHERE n_rows >= 2),
c0 AS (SELECT k.*, len(list_filter(splits, lambda s: s <= (x0 + x1) / 2)) AS col FROM k JOIN g3 USING (id, page) WHERE len(splits) > 0),
c1 AS (SELECT id, page, row, col, string_agg(text, ' ' ORDER BY x0, pos) AS cell FROM c0 GROUP BY ALL),
cells AS (SELECT id, page, CAST(dense_rank() OVER (PARTITION BY id, page ORDER BY row) - 1 AS INTEGER) AS row, CAST(col AS INTEGER) AS col, cell FROM c1 QUALIFY max(col) OVER (PARTITION BY id, page) >= 1)"""
CROPS_SQL = f"""{SET_SQL},
lines AS (SELECT id, page, line, string_agg(text, ' ' ORDER BY pos) AS caption, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words WHERE bars GROUP BY ALL),
z AS (SELECT *, y0 > {HEIGHT} * 0.3 AS above, CASE WHEN y0 > {HEIGHT} * 0.3 THEN 0 ELSE y1 END AS zy0, CASE WHEN y0 > {HEIGHT} * 0.3 THEN y0 ELSE {HEIGHT} END AS zy1 FROM lines),
d AS (SELECT id, page, x0 AS dx0, y0 AS dy0, x1 AS dx1, y1 AS dy1 FROM words WHERE NOT regexp_matches(text, '\\p{{L}}') AND x1 - x0 > 8 AND y1 - y0 > 8),
u AS (SELECT id, page, line, count(*) AS n, min(dx0) AS ux0, min(dy0) AS uy0, max(dx1) AS ux1, max(dy1) AS uy1 FROM z JOIN d USING (id, page) WHERE least(dx1, {WIDTH}) - greatest(dx0, 0) > 8 AND least(dy1, zy1) - greatest(dy0, zy0) > 8 GROUP BY ALL),
j AS (SELECT z.*, n, ux0, uy0, ux1, uy1, coalesce(ux1 - ux0 > 20 AND uy1 - uy0 > 20, false) AS whole, above AND least(200, y0) > 40 AS fall FROM z LEFT JOIN u USING (id, page, line)),
p AS (SELECT id, page, line, CASE WHEN whole THEN n ELSE 0 END AS n_drawn, CASE WHEN whole THEN least(ux0, x0) WHEN fall THEN x0 - 20 END AS a, CASE WHEN whole THEN least(uy0, y0) WHEN fall THEN y0 - least(200, y0) END AS b,
  CASE WHEN whole THEN greatest(ux1, x1) WHEN fall THEN x1 + 20 END AS c, CASE WHEN whole THEN greatest(uy1, y1) WHEN fall THEN y1 END AS e FROM j WHERE whole OR fall),
q AS (SELECT id AS doc, page, line, CAST(greatest(a - 6, 0) AS DOUBLE) AS x0, CAST(greatest(b - 6, 0) AS DOUBLE) AS y0, CAST(least(c + 6, {WIDTH}) AS DOUBLE) AS x1, CAST(least(e + 6, {HEIGHT}) AS DOUBLE) AS y1, n_drawn FROM p),
crops AS (SELECT * FROM q WHERE x1 - x0 >= 20 AND y1 - y0 >= 20)"""
BLOCKS_SQL = f"""t0 AS (SELECT regexp_extract(url, '://([^/:?#]+)', 1) AS doc, page_id AS page, regexp_extract_all(html, '{BLOCK}') AS ts FROM pages),
t1 AS (SELECT doc, page, unnest(ts) AS tag, CAST(unnest(range(0, len(ts))) AS INTEGER) AS block FROM t0),
t2 AS (SELECT doc, page, block, CASE WHEN starts_with(tag, '<h1') THEN 'heading' WHEN starts_with(tag, '<ul') THEN 'table' WHEN starts_with(tag, '<div') THEN 'image' ELSE 'text' END AS kind, regexp_replace(tag, '^<[^>]*>', '') AS raw FROM t1),
bl AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM t2)"""
TITLE_SQL = "(length(text) <= 100 AND regexp_matches(text, '(?i)^(\\d+\\.?\\s+[A-Z]|[IVX]+\\.?\\s+[A-Z]|Abstract|Introduction|Methods|Results|Discussion|Conclusion|References)'))"
#: No block of the pages holds an operator of a formula; the tests have those.
SCAN_SQL = f"""{BLOCKS_SQL},
el AS (SELECT *, CASE WHEN kind = 'image' THEN 'figure' WHEN kind = 'table' THEN 'table' WHEN regexp_matches(text, '(?i)^\\s*(Figure|Fig\\.)\\s*\\d+') THEN 'figure' WHEN kind = 'heading' OR {TITLE_SQL} THEN 'section' ELSE 'text' END AS element FROM bl WHERE kind IN ('image', 'table') OR text <> ''),
nu AS (SELECT *, count(*) FILTER (element = 'figure') OVER o AS figure_no, count(*) FILTER (element = 'table') OVER o AS table_no, count(*) FILTER (element = 'section') OVER o AS section_no FROM el WINDOW o AS (PARTITION BY doc ORDER BY page, block ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, min(section_no - CAST(element = 'section' AS INT)) OVER (PARTITION BY doc, page) AS at_start FROM nu),
fi AS (SELECT *, CASE WHEN element = 'table' THEN at_start ELSE section_no END AS s FROM st WHERE element IN ('figure', 'table'))
SELECT fi.doc, fi.page, fi.block, fi.element, CASE WHEN fi.element = 'table' THEN fi.table_no ELSE fi.figure_no END AS number, md5(coalesce(h.text, '')) AS section_md5,
  md5(CASE WHEN fi.kind = 'image' THEN 'Image from page ' || (fi.page + 1) ELSE replace(fi.text, chr(10), ' ') END) AS text_md5, 36.0::DOUBLE + 3 * length(fi.raw) AS x1, CAST(20 * fi.block AS DOUBLE) AS y0
FROM fi LEFT JOIN nu h ON h.doc = fi.doc AND h.element = 'section' AND h.section_no = fi.s"""
DIGITS_SQL = "array_to_string(list_sort(list_distinct(regexp_extract_all(caption, '\\d+'))), ',')"

def display_sql(c: str) -> str:
    for pattern, new in latex.DISPLAY:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')".replace("\x00\x01", "\\x00\\x01")
    return f"trim({c}, ' ')"


def balanced_sql(c: str, left: str, right: str, cut: bool) -> str:
    lacking = f"((length({c}) - length(replace({c}, '{left}', ''))) - (length({c}) - length(replace({c}, '{right}', ''))))"
    fewer = f"substr({c}, 1, length({c}) - least(-{lacking}, length(regexp_extract({c}, '(\\{right}*)$', 1))))" if cut else c
    return f"CASE WHEN {lacking} < 0 THEN {fewer} ELSE {c} || repeat('{right}', {lacking}) END"


ORACLES = {
    "document_formulas": f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(text, '{latex.BLOCK}', 1) AS ls FROM documents), f AS (SELECT id, unnest(ls) AS raw, CAST(unnest(range(0, len(ls))) AS INTEGER) AS k FROM d), s AS (SELECT id, k, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS x FROM f),
        a AS (SELECT *, {balanced_sql('x', '{', '}', True)} AS y FROM s WHERE length(x) > 2), b AS (SELECT *, {balanced_sql('y', '(', ')', True)} AS z FROM a)
        SELECT id, k, md5(x) AS latex_md5, md5({display_sql('x')}) AS display_md5, md5({balanced_sql('z', '[', ']', False)}) AS balanced_md5 FROM b""",
    "table_cells": f"WITH {CELLS_SQL} SELECT * FROM cells",
    "table_markdown": f"""WITH {CELLS_SQL}, n AS (SELECT id, page, max(col) AS n FROM cells GROUP BY ALL), wd AS (SELECT id, page, col, greatest(max(length(cell)), 3) AS w FROM cells GROUP BY ALL),
        grid AS (SELECT n.id, n.page, r.row, c.col FROM n JOIN (SELECT DISTINCT id, page, row FROM cells) r USING (id, page), LATERAL (SELECT unnest(range(0, n + 1)) AS col) c),
        ce AS (SELECT g.id, g.page, g.row, g.col, rpad(coalesce(cell, ''), CAST(coalesce(w, 3) AS INTEGER), ' ') AS cell, repeat('-', CAST(coalesce(w, 3) AS INTEGER)) AS dash FROM grid g LEFT JOIN cells USING (id, page, row, col) LEFT JOIN wd ON wd.id = g.id AND wd.page = g.page AND wd.col = g.col),
        ro AS (SELECT id, page, row, '| ' || string_agg(cell, ' | ' ORDER BY col) || ' |' AS line, '| ' || string_agg(dash, ' | ' ORDER BY col) || ' |' AS rule FROM ce GROUP BY ALL),
        md AS (SELECT id, page, string_agg(CASE WHEN row = 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY row) AS markdown FROM ro GROUP BY ALL) SELECT id, page, md5(markdown) AS markdown_md5, length(markdown) AS size FROM md""",
    "figure_crops": f"WITH {CROPS_SQL} SELECT * FROM crops",
    "crop_matches": f"""WITH {CROPS_SQL}, h AS (SELECT doc, crops.page AS sheet, crops.line, {DIGITS_SQL} AS numbers FROM crops JOIN lines ON lines.id = doc AND lines.page = crops.page AND lines.line = crops.line),
        a AS (SELECT id AS doc, page AS sheet, line, {DIGITS_SQL} AS numbers FROM lines), r AS (SELECT a.*, h.sheet AS crop_sheet, h.line AS crop_line, row_number() OVER (PARTITION BY a.doc, a.sheet, a.line ORDER BY CASE WHEN h.numbers = a.numbers AND a.numbers <> '' THEN 0 ELSE 1 END, h.sheet, h.line) AS k FROM a LEFT JOIN h USING (doc))
        SELECT doc, sheet, line, crop_sheet, crop_line FROM r WHERE k = 1""",
    "element_scan": f"WITH {SCAN_SQL}",
    "page_numbers": f"WITH {BLOCKS_SQL} SELECT page, block, kind, image_no, heading_no FROM (SELECT *, count(*) FILTER (kind = 'image') OVER o AS image_no, count(*) FILTER (kind = 'heading') OVER o AS heading_no FROM bl WINDOW o AS (ORDER BY page, block ROWS UNBOUNDED PRECEDING)) WHERE kind IN ('image', 'heading')",
    "equation_dedup": """WITH RECURSIVE ln AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS body, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
        c AS (SELECT id, CAST(line * 2 AS INTEGER) AS place, body, 0.7::DOUBLE AS confidence FROM ln WHERE length(body) <= 300 UNION ALL SELECT id, CAST(line * 2 + 1 AS INTEGER), body, 0.95 FROM ln WHERE length(body) <= 300 AND regexp_matches(body, '[0-9%=|]')),
        n AS (SELECT *, regexp_replace(lower(body), '\\s+', '', 'g') AS norm, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, place) AS k FROM c),
        g(id, k, keep, kept) AS (SELECT id, k, true, [norm] FROM n WHERE k = 1 UNION ALL SELECT id, k, keep, CASE WHEN keep THEN list_append(kept, norm) ELSE kept END FROM
          (SELECT n.id, n.k, n.norm, g.kept, len(list_filter(g.kept, lambda s: s = n.norm OR (length(s) > 10 AND length(n.norm) > 10 AND len(list_filter(list_zip(string_split(s, ''), string_split(n.norm, '')), lambda p: p[1] = p[2])) / greatest(length(s), length(n.norm)) > 0.9))) = 0 AS keep FROM g JOIN n ON n.id = g.id AND n.k = g.k + 1))
        SELECT n.id, n.place, n.confidence, md5(n.body) AS body_md5 FROM g JOIN n USING (id, k) WHERE keep""",
    "range_join_bbox": """WITH b AS (SELECT p_brand, p_partkey AS id, p_partkey % 100 AS x0, p_partkey % 100 + p_size % 5 AS x1, p_size * 10 AS y0, p_size * 10 + 15 AS y1 FROM part)
        SELECT a.id, b.id AS b_id FROM b a JOIN b ON a.p_brand = b.p_brand AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
}
