"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents with equal shingle sets are one class, so the matrix has a row a class. A
class's shingles are ordered from rare to frequent, and only as many columns as a
partner within the threshold cannot all miss enter the product (n - ceil(t n) + 1 of
them). The product is taken block by block:

1. Columns of one class are dropped. Each other column links its classes with one of
   them, its centre, if their sizes, a histogram of their sets (the sum over its cells of
   the smaller count is never under the overlap) and at last their whole sets allow it.
   Links give components, and pairs within a component need no further look, so copies and
   near copies are not expanded.
2. Columns whose classes are still of different components are split by set size, so that
   a column holds classes of two neighbouring sizes only: other pairs are below the bound
   that the sizes give. A column is dropped where another holds all its classes.
3. A column of more than TILE cells is split into tiles of classes, and each pair of tiles
   is a block, dealt to a task. First with the histograms of its classes: those without any
   open pair that these allow leave the column. Then as a block of the product, with the
   whole sets of the classes that are left. The task
   accumulates the overlap counts of the block (a dense product for its frequent n-grams, a
   sum over the pairs of an n-gram for the others, or the counts of the pairs alone where
   few are open), discards what is below the threshold, and emits a spanning forest of the
   links that it found: no candidate pair is ever a row, and no link between components is
   lost.

Shingle frequency, which sets only the order, is counted over all documents in a
table of CELLS cells; that table is all that is broadcast. Class and shingle ids are
64-bit hashes; equal texts always meet.

Defined cases: null, empty and wordless texts have no shingle, link with nothing and
are their own component; fewer words than a shingle are one shingle; rows of one set are
one class, whatever their doc_ids, so a null doc_id links what it is similar to; a null
doc_id is never the smallest, and a component of nulls only has a null component_id; very
long texts are read whole; other columns are ignored. ``deduplicated`` keeps one row of a
component, that with the least doc_id (nulls last), of equal ones that with the least hash
of the text, of repeated rows any; rows without shingles all stay, with all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import release, shuffle_partitions, written

SHINGLE = 5
#: Least similarity in hundredths.
THRESHOLD = 80
CELLS = 1 << 18
CHUNK = 1 << 12
SALTS = 32
#: Random orders that centres are taken from.
ORDERS = 8
#: Cells of a tile; a class counts as ROW_CELLS at least, so a tile has at most TILE / ROW_CELLS classes or so.
TILE = 1 << 20
ROW_CELLS = 512
#: Bits of a piece of the bitmap that finds wanted rows, and most bits in it (16 MB).
PIECE = 1 << 16
MOST_BITS = 1 << 27
#: Open pairs of a block above which its whole product is made, and pairs that are looked at together.
FEW_PAIRS, RUN = 20_000, 1 << 19

MEMBER = np.ones(256, dtype=bool)
MEMBER[[32, 9, 10, 11, 12, 13]] = False


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, texts after each other, and each text's first place."""
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, MEMBER)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    hashes = tb.span_hash(tb.prefix_hash(low), starts, ends)
    words = np.diff(first)
    row = np.repeat(np.arange(rows), words)
    place = np.arange(len(hashes)) - first[row]
    begin = np.flatnonzero((place + size <= words[row]) | (place == 0))
    row = row[begin]
    end = begin + np.minimum(size, words[row])
    keys = tb.span_hash(tb.prefix_hash(hashes), begin, end)
    order = np.lexsort([keys, row])
    keys, row = keys[order], row[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[fresh], row[fresh]
    return keys, np.searchsorted(row, np.arange(rows + 1))


def cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall into each cell, over all documents; the result has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column(0), 1 << 20):
                sums += np.bincount(cell(shingles(data, offsets, size)[0]), minlength=CELLS)
        used = [k for k in range(CELLS // CHUNK) if sums[k * CHUNK : (k + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([sums[k * CHUNK : (k + 1) * CHUNK].astype("<i8").tobytes() for k in used], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), dtype="<i8") for b in table.column("counts"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").withColumn("salt", F.spark_partition_id() % SALTS)
    some = parts.groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(CELLS, dtype=np.int64)
    for r in some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, dtype="<i8")
    return out


def needed(n: np.ndarray, threshold: int) -> np.ndarray:
    """ceil(t n): the least overlap with any partner."""
    return -(-threshold * n // 100)


def histogram_size(n: int) -> int:
    return 64 if n < 512 else 256 if n < 4096 else 2048


def histogram(keys: np.ndarray) -> bytes:
    cells = histogram_size(len(keys))
    return np.bincount((keys & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype("<u4" if len(keys) > 65535 else "<u2").tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Never less than the overlap of the sets."""
    x = np.frombuffer(a, "<u4" if na > 65535 else "<u2").astype(np.int64)
    y = np.frombuffer(b, "<u4" if nb > 65535 else "<u2").astype(np.int64)
    least = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, least).sum(axis=0), y.reshape(-1, least).sum(axis=0)).sum())


def set_id(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """An order-free hash of each set, as signed 64-bit."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(keys ^ np.uint64(0xA5A5A5A5DEADBEEF)))])
    return tb.mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64) * np.uint64(tb.BASE)).view(np.int64)


def text_key() -> Column:
    """Hash of a text, which with the doc_id names a row; rows without any word get a number of their own, which meets nothing."""
    return F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text")).otherwise(F.monotonically_increasing_id())


def set_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n, class_id and histogram of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(2), 1 << 20):
                keys, first = shingles(data, offsets, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(np.diff(first), pa.int64()), pa.array(set_id(keys, first)),
                     pa.array([histogram(keys[first[i] : first[i + 1]]) for i in range(end - row)], pa.binary())],
                    names=["doc_id", "text_key", "n", "class_id", "histogram"])
        tb.trim()

    named = docs.select("doc_id", text_key().alias("text_key"), "text")
    return named.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n long, class_id long, histogram binary")


def columns_of(docs: DataFrame, size: int, threshold: int, counts: np.ndarray) -> DataFrame:
    """(token, class_id, n) for the columns that enter the product."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task emits a class once; its size follows the task's input
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column(0), 1 << 20):
                keys, first = shingles(data, offsets, size)
                ids = set_id(keys, first)
                fresh = np.zeros(len(ids), dtype=bool)
                for i, own in enumerate(ids.tolist()):
                    if own not in seen:
                        seen.add(own)
                        fresh[i] = True
                keys = keys[np.repeat(fresh, np.diff(first))]
                n = np.diff(first)[fresh]
                ids = ids[fresh]
                first = np.concatenate([[0], np.cumsum(n)])
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort([keys, shared.value[cell(keys)], row])
                place = np.arange(len(keys)) - first[row]
                chosen = order[place < (n - needed(n, threshold) + 1)[row]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[chosen].view(np.int64)), pa.array(ids[row[chosen]]), pa.array(n[row[chosen]], pa.int64())], names=["token", "class_id", "n"])
        tb.trim()

    return docs.select("text").mapInArrow(make, "token long, class_id long, n long")


def row_name() -> Column:
    return F.xxhash64("doc_id", "text_key")


def bitmap(names: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` (a power of two, PIECE or more) the names of the rows fall on; the result has a bounded size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits, dtype=bool)
        for batch in batches:
            marks[batch.column(0).to_numpy() & (bits - 1)] = True
        used = np.flatnonzero(marks.reshape(-1, PIECE).any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(marks[k * PIECE : (k + 1) * PIECE]).tobytes() for k in used.tolist()], pa.binary())], names=["piece", "marks"])

    def join(table: pa.Table) -> pa.Table:
        every = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in table.column("marks")])
        return pa.table({"piece": table.column("piece").slice(0, 1), "marks": pa.array([every.tobytes()], pa.binary())})

    out = np.zeros((bits // PIECE, PIECE // 8), dtype=np.uint8)
    for r in names.select(row_name().alias("h")).mapInArrow(mark, "piece int, marks binary").groupBy("piece").applyInArrow(join, "piece int, marks binary").collect():
        out[r.piece] = np.frombuffer(r.marks, np.uint8)
    return out.reshape(-1)


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class_id and sorted set (uint64 bytes) of the wanted (class_id, doc_id, text_key) rows, each class once.

    Texts that a bitmap of the wanted rows excludes are left where they are; where it would be more than MOST_BITS,
    texts meet the wanted rows by name instead.
    """
    count = wanted.count()
    bits = 1 << max(PIECE.bit_length() - 1, (32 * count).bit_length())
    rows = docs.select("doc_id", "text", text_key().alias("text_key")).select("text", row_name().alias("h"))
    shared = None
    if count * 4 <= MOST_BITS:
        shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, min(bits, MOST_BITS)))
    else:
        names = wanted.select(row_name().alias("name")).distinct()
        rows = rows.join(names, F.col("h") == F.col("name"), "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                marks = shared.value
                at = batch.column(1).to_numpy() & (8 * len(marks) - 1)
                batch = batch.filter(pa.array((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for row, end, data, offsets in tb.slices(batch.column(0), 1 << 20):
                keys, first = shingles(data, offsets, size)
                ids = set_id(keys, first)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([keys[first[i] : first[i + 1]].tobytes() for i in range(end - row)], pa.binary())], names=["class_id", "keys"])
        tb.trim()

    found = rows.mapInArrow(make, "class_id long, keys binary").join(wanted.select(F.col("class_id").alias("c")), F.col("class_id") == F.col("c"), "left_semi")
    return found.groupBy("class_id").agg(F.first("keys").alias("keys"))


def within_sizes(threshold: int, a: str = "n_a", b: str = "n_b"):
    return (100 * F.least(a, b) >= threshold * F.greatest(a, b))


def bounded(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) pairs that the histograms do not exclude."""
    left = classes.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("histogram").alias("ha"))
    right = classes.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("histogram").alias("hb"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, ha, nb, hb = (c.to_pylist() for c in batch.columns)
            stay = [i for i in range(len(a)) if (100 + threshold) * overlap_bound(ha[i], hb[i], na[i], nb[i]) >= threshold * (na[i] + nb[i])]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in stay], pa.int64()), pa.array([b[i] for i in stay], pa.int64())], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "ha", "nb", "hb").mapInArrow(keep, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) pairs whose whole sets meet the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                overlap = int((both[1:] == both[:-1]).sum())
                if 100 * overlap >= threshold * (len(x) + len(y) - overlap):
                    stay.append(i)
            at = pa.array(stay, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    left = sets.select(F.col("class_id").alias("a"), F.col("keys").alias("ka"))
    right = sets.select(F.col("class_id").alias("b"), F.col("keys").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "kb").mapInArrow(keep, "a long, b long")


class Sets:
    """Whole sets of classes, fetched when a pair first needs them and kept for later pairs."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, threshold: int) -> None:
        self.docs, self.classes, self.size, self.threshold = docs, classes, size, threshold
        self.parts: list[DataFrame] = []

    def have(self) -> DataFrame:
        out = self.parts[0]
        for more in self.parts[1:]:
            out = out.union(more)
        return out

    def fetch(self, named: DataFrame) -> None:
        """Makes sure that have() holds the sets of these distinct class_ids."""
        if self.parts:
            named = named.join(self.have().select("class_id"), "class_id", "left_anti")
        wanted = written(self.classes.join(named, "class_id", "left_semi").select("class_id", "doc_id", "text_key"), "jaccard-wanted")
        if not self.parts or not wanted.isEmpty():
            self.parts.append(written(whole_sets(self.docs, wanted, self.size), "jaccard-sets"))
        release(wanted)

    def links(self, pairs: DataFrame) -> DataFrame:
        """verified() with the sets of the classes in the pairs."""
        self.fetch(pairs.select(F.col("a").alias("class_id")).union(pairs.select(F.col("b").alias("class_id"))).distinct())
        return written(verified(pairs, self.have(), self.threshold), "jaccard-links")

    def release(self) -> None:
        for part in self.parts:
            release(part)


def centre(salt: int = 0) -> Column:
    """One class of a column, chosen by one of ORDERS random orders: copies that share their columns get few centres, spread over the group."""
    return F.min_by("class_id", F.xxhash64("class_id", F.pmod("token", F.lit(ORDERS)), F.lit(salt)))


def components(links: DataFrame) -> DataFrame:
    """(class_id, component) of every linked class: least label of the neighbours, then labels of labels, until nothing moves."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-both")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class_id"), F.least("a", "m").alias("component")), "jaccard-labels")
    while True:
        near = both.join(labels, both.b == labels.class_id).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near, labels.class_id == near.a).select("class_id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        top = labels.select(F.col("class_id").alias("c2"), F.col("component").alias("t"))
        moved = low.join(top, low.component == F.col("c2"), "left").select("class_id", "was", F.least("component", F.coalesce("t", "component")).alias("component"))
        moved = written(moved, "jaccard-labels")
        release(labels)
        labels = moved
        if moved.filter("was <> component").isEmpty():
            release(both)
            return labels


def size_edges(threshold: int) -> list[int]:
    """Where ranges of set sizes begin: sets within the threshold are in one range or in neighbouring ones. Wider ranges than needed are kept few."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(100 * edges[-1] // min(threshold, 95) + 1)
    return edges


def size_range(n: np.ndarray, threshold: int) -> np.ndarray:
    return np.searchsorted(np.array(size_edges(threshold), dtype=np.int64), n, "right")


def size_range_column(threshold: int, column: str = "n") -> Column:
    return F.expr(f"size(filter(array({','.join(f'{e}L' for e in size_edges(threshold))}), e -> e <= {column}))")


def open_columns(placed: DataFrame, threshold: int) -> DataFrame:
    """(token, cell, class_id, n, component): a column for each token and pair of neighbouring size ranges that holds classes of different components."""
    ranged = placed.withColumn("range", size_range_column(threshold))
    cells = ranged.withColumn("cell", F.explode(F.array(F.col("range") - 1, F.col("range"))))
    held = cells.groupBy("token", "cell").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("range").alias("low")).filter("x <> y and low = cell").select(F.col("token").alias("t"), F.col("cell").alias("c"))
    return cells.join(held, (F.col("token") == F.col("t")) & (F.col("cell") == F.col("c"))).select("token", "cell", "class_id", "n", "component")


def pruned(columns: DataFrame) -> DataFrame:
    """The columns without those whose classes another column holds too, and ``tiles``, the number of tiles that each is split into.

    A column is within another if all its classes have the same column just before it, or first of all.
    """
    own = Window.partitionBy("class_id", "cell").orderBy("token")
    ranked = written(columns.withColumn("before", F.lag("token").over(own)).withColumn("first", F.first("token").over(own)), "jaccard-ranked")
    sums = ranked.groupBy("token", "cell").agg(F.min("before").alias("b1"), F.max("before").alias("b2"), F.count("before").alias("nb"), F.count("*").alias("k"), F.min("first").alias("f1"), F.max("first").alias("f2"), F.sum(F.greatest("n", F.lit(ROW_CELLS))).alias("cells"))
    kept = sums.filter("k > 1 and not (nb = k and b1 = b2) and not (f1 = f2 and f1 <> token)").select(F.col("token").alias("t"), F.col("cell").alias("c"), F.ceil(F.col("cells") / TILE).cast("int").alias("tiles"))
    out = written(ranked.join(kept, (F.col("token") == F.col("t")) & (F.col("cell") == F.col("c"))).select("token", "cell", "class_id", "n", "component", "tiles"), "jaccard-columns")
    release(ranked)
    return out


def dealt(columns: DataFrame, held: DataFrame, value: str) -> DataFrame:
    """Rows (token, cell, lo, hi, own, id, component, n, value) of every pair of tiles lo <= hi of a column, dealt to tasks and sorted; ``held`` has the value by class_id."""
    parts = shuffle_partitions(columns.sparkSession)
    own = F.pmod(F.xxhash64("class_id", "token"), F.col("tiles")).cast("int")
    rows = columns.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    blocks = rows.select("token", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", F.col("class_id").alias("id"), "component", "n")
    return blocks.join(held.select("class_id", value), F.col("id") == F.col("class_id")).select("token", "cell", "lo", "hi", "own", "id", "component", "n", value).repartition(parts, "token", "cell", "lo", "hi").sortWithinPartitions("token", "cell", "lo", "hi")


def screened(columns: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Columns of the classes that open pairs within a column join which the histograms do not exclude; token names the cluster."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches):
            held = [np.frombuffer(v, "<u4" if n > 65535 else "<u2") for v, n in zip(block.values, block.n.tolist(), strict=True)]
            cells = min(map(len, held))
            table = np.stack([h.reshape(-1, cells).sum(axis=0, dtype=np.int64) for h in held])
            step = max(1, (1 << 21) // cells)
            label = np.arange(len(block.ids))
            for p, q in open_pairs(block, threshold):
                for i in range(0, len(p), step):
                    a, b = p[i : i + step], q[i : i + step]
                    ok = (100 + threshold) * np.minimum(table[a], table[b]).sum(axis=1) >= threshold * (block.n[a] + block.n[b])
                    if ok.any():
                        label = clusters(label, a[ok], b[ok])
            joined = np.flatnonzero(label != np.arange(len(label)))
            if len(joined):
                own = np.flatnonzero(np.bincount(np.concatenate([joined, label[joined]]), minlength=len(label)))
                order = own[np.lexsort([block.ids[own], label[own]])]
                first = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
                # a cluster is named by its members, so that columns with the same give it once
                name = set_id(block.ids[order].view(np.uint64), np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(name, np.diff(np.append(first, len(order))))), pa.array(np.full(len(order), block.key[1], dtype=np.int32)), pa.array(block.ids[order]), pa.array(block.n[order]), pa.array(block.component[order])],
                    names=["token", "cell", "class_id", "n", "component"])
        tb.trim()

    found = dealt(columns, classes, "histogram").mapInArrow(screen, "token long, cell int, class_id long, n long, component long")
    return found.distinct()


def clusters(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row that each row is joined to by the pairs, from such labels by earlier ones."""
    label = label.copy()
    joined = np.flatnonzero(label != np.arange(len(label)))
    p, q = np.concatenate([p, joined]), np.concatenate([q, label[joined]])
    while True:
        before = label.copy()
        np.minimum.at(label, p, label[q])
        np.minimum.at(label, q, label[p])
        label = label[label]
        if (label == before).all():
            return label


def product(columns: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of a spanning forest of the links between components in each block; see block_links."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: list[Block] = []  # whole small blocks, taken together
        size = 0
        for block in grouped(batches):
            block.values = [np.frombuffer(v, np.uint64) for v in block.values]
            if len(block.ids) > 64:
                yield links_batch(block_links([block], threshold))
                continue
            many.append(block)
            size += int(block.n.sum())
            if size > TILE // 2:
                yield links_batch(block_links(many, threshold))
                many, size = [], 0
        if many:
            yield links_batch(block_links(many, threshold))
        del many
        tb.trim()

    return dealt(columns, sets, "keys").mapInArrow(multiply, "a long, b long")


@dataclass
class Block:
    """Rows of one pair of tiles: class ids, components, set sizes, whether a row is of the second of two tiles, and a value each; key is (token, cell, lo, hi)."""

    key: tuple
    ids: np.ndarray
    component: np.ndarray
    n: np.ndarray
    second: np.ndarray
    values: list


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of the rows that dealt() gives, of two rows or more; one is held at a time."""
    parts: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        table = [batch.column(i).to_numpy() for i in range(4)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in table], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], edge, [batch.num_rows]])
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if low == high:
                continue
            own = tuple(int(c[low]) for c in table)
            if own != key:
                if sum(p.num_rows for p in parts) > 1:
                    yield block_of(key, parts)
                key, parts = own, []
            parts.append(batch.slice(low, high - low))
    if sum(p.num_rows for p in parts) > 1:
        yield block_of(key, parts)


def block_of(key: tuple, parts: list[pa.RecordBatch]) -> Block:
    own, ids, component, n = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (4, 5, 6, 7))
    return Block(key, ids, component, n, (own == key[3]) & (key[2] != key[3]), [v for p in parts for v in p.column(8).to_pylist()])


def links_batch(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], names=["a", "b"])


def open_pairs(block: Block, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of different components, of sizes within the threshold, at least one in the block's lower size range and, in a block of two tiles, of different tiles.

    They come in runs of about RUN pairs, so that a block's pairs are never held together.
    """
    low = size_range(block.n, threshold) == block.key[1]
    rows = np.argsort(block.n, kind="stable")
    size = block.n[rows]
    # of a row's later partners only those near in size are looked at
    last = np.searchsorted(size, 100 * size // threshold, "right")
    count = np.maximum(0, last - np.arange(len(rows)) - 1)
    ends = np.cumsum(count)
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - count[begin] + RUN, "right")))
        own = count[begin:end]
        p = np.repeat(np.arange(begin, end), own)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(own) - own, own)
        p, q = rows[p], rows[q]
        ok = (block.component[p] != block.component[q]) & (low[p] | low[q])
        if block.key[2] != block.key[3]:
            ok &= block.second[p] != block.second[q]
        if ok.any():
            yield p[ok], q[ok]
        begin = end


def block_links(blocks: list[Block], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between components in the blocks, thinned to a spanning forest of them."""
    ids, component, n = (np.concatenate([getattr(b, k) for b in blocks]) for k in ("ids", "component", "n"))
    keys = [k for b in blocks for k in b.values]
    if len(blocks) > 1:
        pairs, first = [], 0
        for b in blocks:
            pairs += [(p + first, q + first) for p, q in open_pairs(b, threshold)]
            first += len(b.ids)
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
        _, once = np.unique(np.column_stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])]), axis=0, return_index=True)
        runs = iter([(p[once], q[once])])
    else:
        runs = open_pairs(blocks[0], threshold)
    whole = None
    kept_p = kept_q = np.zeros(0, np.int64)
    for p, q in runs:
        if whole is None and (len(blocks) > 1 or len(p) <= FEW_PAIRS):
            overlap = pair_overlaps(keys, n, p, q)
        else:
            whole = block_overlaps(keys, n) if whole is None else whole
            overlap = whole[p, q].astype(np.int64)
        link = 100 * overlap >= threshold * (n[p] + n[q] - overlap)
        if link.any():
            p, q = np.concatenate([kept_p, p[link]]), np.concatenate([kept_q, q[link]])
            tree = forest(component, p, q)
            kept_p, kept_q = p[tree], q[tree]
    return ids[kept_p], ids[kept_q]


def pair_overlaps(keys: list[np.ndarray], n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Overlap of each pair of sets: the members of the smaller are looked up in the other."""
    _, code = np.unique(np.concatenate(keys), return_inverse=True)
    code = code.reshape(-1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    width = int(code.max()) + 1 if len(code) else 1
    placed = code + np.repeat(np.arange(len(n)), n) * width  # ascending, as each set is sorted
    swap = n[p] > n[q]
    small, large = np.where(swap, q, p), np.where(swap, p, q)
    out = np.zeros(len(p), dtype=np.int64)
    sizes = n[small]
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(p):  # about a million members at a time
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + (1 << 20), "right")))
        take, count = small[begin:end], sizes[begin:end]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wanted = code[np.repeat(first[take], count) + inside] + np.repeat(large[begin:end], count) * width
        spot = np.minimum(np.searchsorted(placed, wanted), len(placed) - 1)
        hit = np.concatenate([[0], np.cumsum(placed[spot] == wanted)])
        out[begin:end] = hit[np.cumsum(count)] - hit[np.cumsum(count) - count]
        begin = end
    return out


def block_overlaps(keys: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """The product of the block's incidence with its transpose: overlap counts of all pairs of rows."""
    rows = len(n)
    _, code, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    code, row = code.reshape(-1), np.repeat(np.arange(rows), n)
    out = np.zeros((rows, rows), dtype=np.float32)  # counts below 2**24 are exact
    frequent = np.flatnonzero(times * 16 >= rows)
    number = np.full(len(times), -1, dtype=np.int64)
    number[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), 1024):
        mine = (number[code] >= at) & (number[code] < at + 1024)
        dense = np.zeros((rows, min(1024, len(frequent) - at)), dtype=np.float32)
        dense[row[mine], number[code[mine]] - at] = 1
        for i in range(0, rows, 512):
            out[i : i + 512] += dense[i : i + 512] @ dense.T
    rare = (number[code] < 0) & (times[code] > 1)
    order = np.argsort(code[rare], kind="stable")
    held, kind = row[rare][order], code[rare][order]
    if len(held):
        count = times[kind]  # every member of an n-gram's column meets the whole column
        begin = np.searchsorted(kind, kind, "left")
        bounds = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(held):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 20), "right")) - 1)
            own = count[at:end]
            partner = held[np.repeat(begin[at:end], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
            np.add.at(out.reshape(-1), np.repeat(held[at:end], own) * rows + partner, 1)
            at = end
    return out


def forest(component: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[int]:
    """Which of the links (rows p and q) join components not yet joined."""
    kinds, place = np.unique(component, return_inverse=True)
    place = place.reshape(-1)
    low, high = np.minimum(place[p], place[q]), np.maximum(place[p], place[q])
    _, once = np.unique(low * np.int64(len(kinds)) + high, return_index=True)
    top = list(range(len(kinds)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    kept = []
    for k in once.tolist():
        a, b = find(int(low[k])), find(int(high[k]))
        if a != b:
            top[b] = a
            kept.append(k)
    return kept


def row_groups(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, text_key, n, class_id, n_copies and least (struct of no_id, doc_id, text_key: the component's first row) of every document row; the last three are null without shingles."""
    counts = frequencies(docs, size)
    rows = written(set_rows(docs, size), "jaccard-rows")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = rows.filter("n > 0").groupBy("class_id").agg(F.min(name).alias("least"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("histogram").alias("histogram"))
    classes = written(classes.select("class_id", "least", F.col("least.doc_id").alias("doc_id"), F.col("least.text_key").alias("text_key"), "n_copies", "n", "histogram"), "jaccard-classes")
    # one shuffle by token serves the distinct, the group and the join
    token_key = columns_of(docs, size, threshold, counts).repartition("token").groupBy("token", "class_id").agg(F.first("n").alias("n"))
    # n is kept on both sides, so that both read the same shuffle
    held = token_key.groupBy("token").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.max("n").alias("most"), centre().alias("centre")).filter("low <> high and most > 0").select(F.col("token").alias("t"), "centre")
    shared = written(token_key.join(held, F.col("token") == F.col("t")).select("token", "class_id", "n", "centre"), "jaccard-columns")
    sizes = classes.select(F.col("class_id").alias("c"), F.col("n").alias("n_b"))
    sets = Sets(docs, classes, size, threshold)

    def starred(incidence: DataFrame) -> DataFrame:
        pairs = incidence.filter("class_id <> centre").select(F.col("centre").alias("a"), F.col("class_id").alias("b"), F.col("n").alias("n_a")).distinct()
        pairs = pairs.join(sizes, pairs.a == sizes.c).filter(within_sizes(threshold)).select("a", "b")
        near = written(bounded(pairs, classes, threshold), "jaccard-stars")
        out = sets.links(near)
        release(near)
        return out

    def still_open(known: DataFrame) -> DataFrame:
        """The columns whose classes are of different components."""
        placed = shared.join(known.select("class_id", "component"), "class_id", "left").select("token", "class_id", "n", F.coalesce("component", "class_id").alias("component"))
        tokens = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
        return written(placed.join(tokens, "token", "left_semi"), "jaccard-open")

    links = starred(shared)
    known = components(links)
    placed = still_open(known)
    done = [shared, links, known, placed]
    columns = pruned(open_columns(placed, threshold))
    done.append(columns)
    if not columns.isEmpty():
        left = pruned(screened(columns, classes, threshold))
        sets.fetch(left.select("class_id").distinct())
        more = written(product(left, sets.have(), threshold), "jaccard-product")
        known = components(links.union(more))
        done += [left, more, known]
    named = classes.join(known.select("class_id", "component"), "class_id", "left").select("class_id", "least", "n_copies", F.coalesce("component", "class_id").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("least"))
    answer = written(named.drop("least").join(first, "component").select("class_id", "least", "n_copies"), "jaccard-answer")
    for table in (*done, classes):
        release(table)
    sets.release()
    return rows.join(answer, "class_id", "left").select("doc_id", "text_key", "n", "class_id", "n_copies", "least")


def similarity_components(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_copies of every document row."""
    return row_groups(docs, size, threshold).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all columns; rows without shingles stay."""
    groups = row_groups(docs, size, threshold).filter("n > 0").groupBy("doc_id", "text_key").agg(F.first("least").alias("least"), F.count("*").alias("times"))
    stays = (F.col("text_key") == F.col("least.text_key")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    fate = written(groups.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__wanted"), stays.alias("stays"), "times").filter("not stays or times > 1"), "jaccard-fate")
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    keyed = plain.withColumn("__doc", doc_id).withColumn("text", text).withColumn("__key", text_key()).drop("text")

    def met(names: DataFrame):
        return keyed.join(names, (F.col("__key") == F.col("__wanted")) & F.col("__doc").eqNullSafe(F.col("__id")), "left_anti")

    out = met(fate)
    repeated = fate.filter("stays")
    if not repeated.isEmpty():
        again = keyed.join(repeated, (F.col("__key") == F.col("__wanted")) & F.col("__doc").eqNullSafe(F.col("__id")), "left_semi")
        out = out.unionByName(again.dropDuplicates(["__doc", "__key"]))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
