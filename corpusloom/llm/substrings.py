"""Removal of long repeated byte strings by suffix arrays over the places where texts can repeat.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a smaller
doc_id, or earlier in the same document) is removed; strings are judged on the input.

1. Winnowing: of the ANCHOR-byte grams of a window of ``length`` bytes, the one with the
   least hash (the leftmost of equals) is its anchor, so equal windows have equal anchors
   at equal distances. Neighbouring windows with one anchor are a segment.
2. Segments are grouped by anchor. Equal segments are one string with many places: all
   but the first are repeats throughout. An anchor with one distinct segment is done.
3. Of the others, the bytes are fetched, cut down to the windows whose hash occurs in
   more than one of them (no equal windows are lost), and put together in blocks by
   anchor. A block's suffix array, by grouping, brings equal windows together; neighbours
   are compared byte by byte and all but the earliest window are repeats.
4. Each document's repeated windows are merged to spans and cut out.

A segment is a few numbers; texts are dealt once, by document. An anchor shared by
many different contexts is one group of step 3: its windows are hashed first, equal runs
of windows that repeat become one, and what is left is sorted in blocks of about BLOCK
bytes, more only where one anchor has more.

Defined cases: a null text is empty; texts shorter than ``length`` are kept whole;
repeated rows and doc_ids are documents in the order of doc_id and text, null doc_ids
first; texts of any length are judged whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.llm.shared import shuffle_partitions, written
from corpusloom.llm.suffixarray import suffix_array

LENGTH = 100
ANCHOR = 32
BLOCK = 1 << 16
OTHER_BASE = 0xC2B2AE3D27D4EB4F | 1


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least upper half of a key (the first of equals) in every run of ``width`` keys."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    most = np.iinfo(np.uint64).max
    tagged = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    blocks = np.append(tagged, np.full(pad, most, dtype=np.uint64)).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, hash of the segment and its anchor's place)."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    prefix = tb.prefix_hash(data)
    grams = np.arange(len(data) - anchor + 1)
    hashes = tb.span_hash(prefix, grams, grams + anchor)
    at = least_places(hashes, length - anchor + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.flatnonzero(row[: len(at)] == row[length - 1 :])
    if not len(windows):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    fresh = np.ones(len(windows), dtype=bool)
    fresh[1:] = (at[windows[1:]] != at[windows[:-1]]) | (np.diff(windows) != 1)
    begin = np.flatnonzero(fresh)
    first = windows[begin]
    count = np.diff(np.append(begin, len(windows)))
    other = tb.prefix_hash(data, OTHER_BASE)
    end = first + count + length - 1
    context = tb.mix(tb.span_hash(prefix, first, end) ^ tb.mix(tb.span_hash(other, first, end, OTHER_BASE) + (at[first] - first).astype(np.uint64)))
    return row[first], first - offsets[row[first]], count, hashes[at[first]], context


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and a unique ``__key`` in the order of doc_id and text: doc_id itself where that is unique."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if whole and ids.isEmpty():
        return rows.withColumn("__key", F.col("doc_id").cast("long"))
    ordered = rows.orderBy(F.asc_nulls_first("doc_id"), "text").withColumn("__key", F.monotonically_increasing_id())
    return written(ordered, "substring-keys")


def segment_rows(keyed: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, context, key, at, done): at is the first window shifted by 20 bits and the number of windows.

    Of equal segments of one slice only the earliest is dealt by its anchor; the others are
    done, since they repeat it, and are dealt by their place, so copies do not meet in a task.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for begin, _, data, offsets in tb.slices(batch.column(1), 1 << 20):
                row, first, count, anchors, context = segments(data, offsets, length, anchor)
                own = keys[begin + row]
                same = tb.mix(anchors) ^ context
                order = np.lexsort([first, own, same])
                again = order[1:][same[order[1:]] == same[order[:-1]]]
                done = np.zeros(len(own), dtype=bool)
                done[again] = True
                anchors[again] = tb.mix(own[again].view(np.uint64) * np.uint64(tb.BASE) + first[again].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(context.view(np.int64)), pa.array(own), pa.array((first << 20) | count), pa.array(done)],
                    names=["anchor", "context", "key", "at", "done"])

    return keyed.select("__key", "text").mapInArrow(make, "anchor long, context long, key long, at long, done boolean")


def gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*held, strict=True)] if held else []


def judged(rows: DataFrame, parts: int) -> DataFrame:
    """(key, at, anchor): segments that repeat throughout (anchor null), and first ones whose anchor has others."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = gathered(batches)
        if not columns:
            return
        anchors, context, key, at, done = columns
        if done.any():
            own = np.flatnonzero(done)
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(at[own]), pa.nulls(len(own), pa.int64())], names=["key", "at", "anchor"])
            anchors, context, key, at = anchors[~done], context[~done], key[~done], at[~done]
        if not len(anchors):
            return
        order = np.lexsort([at, key, context, anchors])
        anchors, context, key, at = anchors[order], context[order], key[order], at[order]
        new_anchor = np.append(True, anchors[1:] != anchors[:-1])
        first = new_anchor | np.append(True, context[1:] != context[:-1])
        kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_anchor))
        several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(new_anchor), len(anchors))))
        for chosen, null in ((~first, True), (first & several, False)):
            where = np.flatnonzero(chosen)
            for part in range(0, len(where), 1 << 16):
                own = where[part : part + (1 << 16)]
                names = pa.nulls(len(own), pa.int64()) if null else pa.array(anchors[own])
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(at[own]), names], names=["key", "at", "anchor"])

    return rows.repartition(parts, "anchor").mapInArrow(split, "key long, at long, anchor long")


def fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, key, first, bytes) of the wanted segments."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, key in enumerate(batch.column(1).to_pylist()):
                data = batch.column(2)[i].as_buffer().to_pybytes()
                for part in batch.column(3)[i].as_py():
                    first, count = part["at"] >> 20, part["at"] & 0xFFFFF
                    out.append((part["anchor"], key, first, data[first : first + count + length - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out, strict=True)), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "key", "first", "bytes"])

    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "at")).alias("parts"))
    return texts.join(lists, texts["__key"] == lists.key).select("doc_id", "__key", "text", "parts").mapInArrow(cut, "anchor long, key long, first long, bytes binary")


def repeats_in_block(data: np.ndarray, valid: np.ndarray, key: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Places of the block whose window of ``length`` bytes also starts earlier; ``valid`` windows only."""
    order = suffix_array(data)
    order = order[valid[order]]
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    equal = np.zeros(len(order), dtype=bool)
    for at in range(1, len(order), 1 << 13):
        end = min(len(order), at + (1 << 13))
        equal[at:end] = (rows[order[at:end]] == rows[order[at - 1 : end - 1]]).all(axis=1)
    number = np.cumsum(~equal)
    by_place = np.lexsort([start[order], key[order], number])
    later = np.append(False, number[by_place][1:] == number[by_place][:-1])
    return order[by_place][later]


def repeated_windows(parts: DataFrame, length: int, count: int) -> DataFrame:
    """(key, at) runs of windows that repeat, from segments with a common anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, keys, firsts, pieces = [], [], [], []
        for batch in batches:
            anchors.append(batch.column(0).to_numpy())
            keys.append(batch.column(1).to_numpy())
            firsts.append(batch.column(2).to_numpy())
            pieces += batch.column(3).to_pylist()
        if not pieces:
            return
        anchor, key, first = np.concatenate(anchors), np.concatenate(keys), np.concatenate(firsts)
        order = np.argsort(anchor, kind="stable")
        for group in runs_of(anchor[order], np.array([len(pieces[i]) for i in order.tolist()]), 1 << 20):
            own = order[group[0] : group[1]]
            for out_key, out_first, out_count in shared_runs([pieces[i] for i in own.tolist()], anchor[own], key[own], first[own], length):
                yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array((out_first << 20) | out_count)], names=["key", "at"])

    return parts.repartition(count, "anchor").mapInArrow(find, "key long, at long")


def runs_of(names: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole groups with about ``most`` bytes."""
    edges = np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names))
    total = np.append(0, np.cumsum(sizes))
    begin = 0
    for k in range(1, len(edges)):
        if k == len(edges) - 1 or total[edges[k + 1]] - total[edges[begin]] > most:
            yield int(edges[begin]), int(edges[k])
            begin = k


def shared_runs(pieces: list[bytes], anchor: np.ndarray, key: np.ndarray, first: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes all windows, keeps runs of those that occur twice, and sorts these in blocks by what their windows hold."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.append(0, np.cumsum(sizes))
    windows = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = begin[piece] + within
    hashes = tb.span_hash(tb.prefix_hash(data), place, place + length)
    kinds, number, often = np.unique(hashes, return_inverse=True, return_counts=True)
    number = number.reshape(-1)
    twice = often[number] > 1
    if not twice.any():
        return
    chosen = np.flatnonzero(twice)
    fresh = np.ones(len(chosen), dtype=bool)
    fresh[1:] = (piece[chosen[1:]] != piece[chosen[:-1]]) | (np.diff(chosen) != 1)
    run_begin = np.flatnonzero(fresh)
    run_count = np.diff(np.append(run_begin, len(chosen)))
    run_first = chosen[run_begin]
    run_piece = piece[run_first]
    run_key, run_start = key[run_piece], first[run_piece] + within[run_first]
    text_at, text_size = place[run_first], run_count + length - 1
    # equal runs are one string: the earliest stands for them, the others repeat it throughout
    named = tb.span_hash(tb.prefix_hash(data), text_at, text_at + text_size)
    order = np.lexsort([run_start, run_key, named])
    again = order[1:][named[order[1:]] == named[order[:-1]]]
    if len(again):
        yield run_key[again], run_start[again], run_count[again]
    own = np.setdiff1d(np.arange(len(named)), again)
    # equal windows have equal anchors, so an anchor's runs stay in one block
    for low, high in runs_of(anchor[run_piece[own]], text_size[own] + 1, BLOCK):
        runs = own[low:high]
        yield from sorted_block(data, text_at[runs], text_size[runs], run_count[runs], run_key[runs], run_start[runs], length)


def sorted_block(data: np.ndarray, at: np.ndarray, size: np.ndarray, count: np.ndarray, key: np.ndarray, first: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One suffix array over the runs, each closed by a symbol that no window holds."""
    total = int((size + 1).sum())
    begin = np.append(0, np.cumsum(size + 1))[:-1]
    run = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(total) - begin[run]
    text = np.zeros(total, dtype=np.int16)
    real = inside < size[run]
    text[real] = data[at[run[real]] + inside[real]].astype(np.int16) + 1
    valid = inside < count[run]
    repeats = np.sort(repeats_in_block(text, valid, key[run], first[run] + inside, length))
    if not len(repeats):
        return
    fresh = np.ones(len(repeats), dtype=bool)
    fresh[1:] = (np.diff(repeats) != 1) | (run[repeats[1:]] != run[repeats[:-1]])
    head = np.flatnonzero(fresh)
    yield key[run[repeats[head]]], first[run[repeats[head]]] + inside[repeats[head]], np.diff(np.append(head, len(repeats)))


def deduplicated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, spans (array of start and end bytes) of every document."""
    if anchor > length:
        raise ValueError("the anchor must fit into the length")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    keyed = keyed_documents(docs)
    verdicts = written(judged(segment_rows(keyed, length, anchor), parts), "substring-segments")
    texts = keyed.select("doc_id", "text", "__key").repartition(parts, "__key")
    found = repeated_windows(fetched(texts, verdicts.filter("anchor is not null"), length), length, parts)
    ranges = verdicts.filter("anchor is null").select("key", "at").unionByName(found)
    lists = ranges.groupBy("key").agg(F.collect_list("at").alias("ranges"))
    whole = texts.join(lists, texts["__key"] == lists.key, "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, removed, spans = [], [], [], []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer().to_pybytes()
                ranges = batch.column(2)[i]
                out: list[dict[str, int]] = []
                if ranges.is_valid:
                    at = np.sort(ranges.values.to_numpy())
                    start, end = at >> 20, (at >> 20) + (at & 0xFFFFF) + length - 1
                    reach = np.maximum.accumulate(end)
                    head = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                    out = [{"start": a, "end": b} for a, b in zip(start[head].tolist(), reach[np.append(head[1:], len(at)) - 1].tolist(), strict=True)]
                rest, last = [], 0
                for s in out:
                    rest.append(data[last : s["start"]])
                    last = s["end"]
                rest.append(data[last:])
                kept.append(b"".join(rest))
                size.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                spans.append(out)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span)], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")


def summary(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    out = deduplicated(docs, length)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
