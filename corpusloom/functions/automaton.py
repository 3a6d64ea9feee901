"""Many strings looked for in one pass over each text, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings of one automaton, which a task holds whole; more are looked for in several passes.
NEEDLES = 100_000


def compiled(needles: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, needle in enumerate(needles):
        automaton.add_word(needle, k)
    automaton.make_automaton()
    return automaton


def term_hits(docs: DataFrame, key: str, body: str, needles: DataFrame, most: int = NEEDLES) -> DataFrame:
    """(key, needle), once each, for every string of the column ``needle`` that the text holds; the empty string is held by every text that is not null.

    Strings come to the driver in blocks of ``most`` at most and go to the tasks as a broadcast; each task compiles them once.
    """
    spark = docs.sparkSession
    wanted = needles.select("needle").filter("needle IS NOT NULL").distinct()
    blocks = max(1, -(-wanted.count() // most))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(body).alias("body"))
    found = None
    for i in range(blocks):
        # a block is bounded by the hash's spread: twice ``most`` is never met in practice, and costs memory only
        own = [r.needle for r in wanted.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == i).toLocalIterator()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            full = [n for n in held if n]
            empty = len(full) < len(held)
            automaton = compiled(full) if full else None
            for batch in batches:
                keys, names = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    if text is None:
                        continue
                    hits = {full[n] for _, n in automaton.iter(text)} if automaton is not None else set()
                    if empty:
                        hits.add("")
                    keys += [k] * len(hits)
                    names += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(names, pa.string())], names=[key, "needle"])

        hits = rows.mapInArrow(run, f"`{key}` {kind}, needle string")
        found = hits if found is None else found.unionByName(hits)
    return found
