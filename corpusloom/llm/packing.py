"""Best-fit packing of token sequences with large-item matching.

A text's ids end with END_ID; a longer list than the capacity is cut into full pieces,
of which the first may be shorter. Pieces above a third of the capacity are large: at
most two share a sequence, matched greedily, the largest with the largest that fits
beside it. Smaller pieces then go, largest first, to the sequence with the tightest
gap that holds them; what no gap holds opens sequences of its own.

Lengths are small integers, so the plan is made on their counts: a plan row says where
the pieces of one length with ranks in a range go. The driver holds counts by length
and plan rows, both bounded by the capacity and not by the data. The ranks
come from counts by task and length: pieces are written once, numbered within their
file by length, and each file's first rank is a prefix sum.

Defined cases: a null text is empty and gives the one piece [END_ID]; repeated rows are
packed each; equal lengths are ranked by file and place; an empty table gives no rows;
other columns are ignored. Texts of any length are tokenised whole, in slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import written

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.llm.tokens import UnitTokenizer

        encoder = UnitTokenizer(tokenizer or tokenizer_path())
        for batch in batches:
            doc_ids = batch.column(0)
            for row, _, data, offsets in tb.slices(batch.column(1), 1 << 20):
                ids, first = encoder.encode(data, offsets)
                ids = ids.astype("<u4")
                out: list[tuple[int, int, int, int, int]] = []
                held = []
                for i in range(len(first) - 1):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                    n, start, piece = len(own), 0, 0
                    size = n if n <= capacity else (n % capacity or capacity)
                    while start < n:
                        part = own[start : start + size]
                        out.append((row + i, piece, start, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            held.append(part.astype(np.int32))
                        start, piece, size = start + size, piece + 1, capacity
                at, piece, start, length, crc = map(list, zip(*out, strict=True)) if out else ([],) * 5
                columns = [doc_ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        del encoder
        tb.trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, pieces a sequence, offset) rows for counts by length."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, how many)
    bins = 0

    def put(length: int, first: int, sequences: int, each: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + sequences * each, first, each, offset))
        used[length] += sequences * each
        left[length] -= sequences * each

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] and (m != n or left[n] > 1)), None)
            if mate is None:
                many = left[n]
                put(n, bins, many, 1, 0)
                gap = capacity - n
            elif mate == n:
                many = left[n] // 2
                put(n, bins, many, 2, 0)
                gap = capacity - 2 * n
            else:
                many = min(left[n], left[mate])
                put(n, bins, many, 1, 0)
                put(mate, bins, many, 1, n)
                gap = capacity - n - mate
            gaps[gap].append((bins, many))
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity + 1):
            while left[n] and gaps[gap]:
                first, many = gaps[gap].pop()
                each = gap // n
                full = min(many, left[n] // each)
                if full:
                    put(n, first, full, each, capacity - gap)
                    gaps[gap - each * n].append((first, full))
                if many > full:
                    rest = left[n] if left[n] < each else 0
                    if rest:
                        put(n, first + full, 1, rest, capacity - gap)
                        gaps[gap - rest * n].append((first + full, 1))
                    over = many - full - bool(rest)
                    if over:
                        gaps[gap].append((first + full + bool(rest), over))
                    break
        if left[n]:
            each = capacity // n
            full, rest = divmod(left[n], each)
            if full:
                put(n, bins, full, each, 0)
                gaps[capacity - each * n].append((bins, full))
                bins += full
            if rest:
                put(n, bins, 1, rest, 0)
                gaps[capacity - rest * n].append((bins, 1))
                bins += 1
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY, label: str = "pieces") -> DataFrame:
    """The pieces with sequence_id and offset; ``cut`` is computed once and written to the shared folder."""
    columns = cut.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            within = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = within
            place += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*columns, "__place"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    numbered = written(cut.mapInArrow(number, f"{types}, __place long").withColumn("__task", F.spark_partition_id()), label)
    tally = numbered.groupBy("__task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    first = tally.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("__task", "length", "__first")
    counts = {int(r.length): int(r.n) for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table: dict[int, np.ndarray] = {}
    for row in plan(counts, capacity):
        table.setdefault(row[0], []).append(row[1:])
    table = {n: np.array(sorted(x), dtype=np.int64) for n, x in table.items()}
    shared = cut.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy().astype(np.int64)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                rows = shared.value[n]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                turn = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + turn // row[:, 3]
                offset[own] = row[:, 4] + turn % row[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    ranked = numbered.join(first, ["__task", "length"]).select(*columns, (F.col("__place") + F.col("__first")).alias("__rank"))
    return ranked.mapInArrow(place, f"{types}, sequence_id long, offset long")
