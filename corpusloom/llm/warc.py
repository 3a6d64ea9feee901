"""WARC archives: writing, and reading by boundary-chain verification.

Writing. Each row becomes a record; rows with equal payloads of at least ``min_bytes``
share one response, that of the smallest page_id, and the others are revisit records
that refer to it and carry no payload. Spark's text writer puts the records into
files, with the blank lines that end a record as its separator, so any store Spark can
write to holds them. Offsets are those of the uncompressed bytes.

Reading. A file, of about FILE_BYTES at most as written here, is one row of Spark's binary
reader (which takes files up to 2 GB). Every place where the magic stands is a candidate record, and its header says where its successor begins; magic inside a
payload gives candidates too. Tasks emit (place, successor); then, for each block of
BLOCK bytes of a file, chains inside the block are contracted by pointer jumping: a
candidate points to the first place of its chain beyond the block. Blocks of a file then meet by their
entry places: pointer jumping from the file's start over these retains what is
reachable, and a task keeps the records that the chain from its block's entry visits.

Defined cases: null html is an empty payload; a null url is an empty target; pages with
the same page_id are a record each, and those with the group's smallest page_id are all
responses; a null page_id counts as larger than any other and only refers or is
referred to when its group has no other; empty tables give no rows; other columns are
ignored. Payloads may hold the magic, header lines, line ends and any Unicode text.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import release, remove, shared_path, written

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
#: Bytes of a written file, about; a record is never cut, so a larger one is a file of its own.
FILE_BYTES = 64 << 20
SMALL = 16 << 10
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def one_line(text: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", text or "")


def record(page_id: int | None, url: str | None, payload: str, payload_digest: str, refers_to: int | None) -> str:
    """A whole record but for the blank lines at its end."""
    body = payload.encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(body)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(body)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + ("" if revisit else payload)


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, __digest (bare base32 SHA-1 of the UTF-8 payload)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2).fill_null("")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), html, pa.array([digest(x.encode()) for x in html.to_pylist()], pa.string())], names=["page_id", "url", "html", "digest"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(add, "page_id long, url string, html string, digest string")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Writes the rows as WARC files of about FILE_BYTES at most below ``path``, each compressed as a whole (``none``: plain).

    Spark's writer rotates by records, so payloads are written by size class (powers of 4 above SMALL), each with its
    own number of records a file.
    """
    marked = with_digests(pages)
    groups = (marked.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("__keeper"), F.count("*").alias("__n"))
              .filter("__n > 1 and __keeper is not null").select(F.col("digest").alias("__digest"), "__keeper"))
    joined = marked.join(groups, (F.col("digest") == F.col("__digest")) & (F.octet_length("html") >= min_bytes), "left").select("page_id", "url", "html", "digest", "__keeper")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, html, own, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(record(page_id, url, html, own, keeper if keeper is not None and keeper != page_id else None))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    size = F.greatest(F.ceil(F.log(4.0, F.octet_length("html") / SMALL)), F.lit(0)).cast("int")
    rows = joined.withColumn("__class", F.when(F.octet_length("html") <= SMALL, 0).otherwise(size))
    sizes = pages.select(F.when(F.octet_length("html") <= SMALL, 0).otherwise(F.coalesce(size, F.lit(0))).alias("c")).distinct().collect()
    for k in sorted(r.c for r in sizes) or [0]:
        own = rows.filter(F.col("__class") == k) if len(sizes) > 1 else rows
        records = max(1, FILE_BYTES // (SMALL * 4**k))
        own.drop("__class").mapInArrow(render, "value string").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).option("compression", compression).text(path)


#: A header line with its continuations.
HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*(?:\r\n[ \t][^\r\n]*)*)\r\n")


def header_at(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """The header fields from ``at`` on and where the block after them begins; None if a line comes first that is neither header nor blank.

    The next magic is such a line, so that no line is looked at for more than one magic and hostile payloads cost no more than others.
    """
    fields: dict[bytes, bytes] = {}
    while (m := HEADER.match(data, at)) is not None:
        fields[m[1].lower()] = m[2]
        at = m.end()
    return (fields, at + 2) if data[at : at + 2] == b"\r\n" else None


def candidates(data: bytes) -> list[tuple[int, int, dict[bytes, bytes], int]]:
    """(place, successor, header fields, where the block begins) of every place that could begin a record."""
    out = []
    at = data.find(MAGIC)
    while at >= 0:
        if (header := header_at(data, at + len(MAGIC))) is not None:
            fields, body = header
            length = fields.get(b"content-length", b"").strip()
            if length.isdigit():
                after = body + int(length) + len(END)
                if after <= len(data) and data[after - 4 : after] == b"\r\n\r\n":
                    out.append((at, after, fields, body))
        at = data.find(MAGIC, at + 1)
    return out


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of every file: path, place, successor and the record's fields, digests taken over the bytes read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for at, after, f, body in candidates(data):
                    payload = data[body : after - 4]
                    page, refers = f.get(b"x-page-id", b""), f.get(b"x-refers-to-page", b"")
                    kind = f.get(b"warc-type", b"").decode("utf-8", "replace")
                    told = f.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
                    size = f.get(b"x-payload-length", b"")
                    full = kind != "revisit"
                    rows.append((name, at, after, int(page) if page.lstrip(b"-").isdigit() else None, f.get(b"warc-target-uri", b"").decode("utf-8", "replace"), kind,
                                 len(payload) if full else int(size) if size.isdigit() else None, digest(payload) if full else told, int(refers) if refers.lstrip(b"-").isdigit() else None))
                    if len(rows) == 2000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, "path string, place long, successor long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long")


KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
NAMES = ["path", "place", "successor", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), KINDS, strict=True)], names=NAMES)


#: Bytes of a file whose chain one task contracts.
BLOCK = 4 << 20


def contracted(places: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's chain followed as far as the places go: where it leads, by pointer jumping."""
    spot = np.minimum(np.searchsorted(places, successors), len(places) - 1)
    inside = places[spot] == successors
    jump = np.where(inside, spot, np.arange(len(places)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return successors[jump], jump


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from byte 0 of their file visits, other candidates of their bytes rejected."""
    blocks = found.select("path", F.floor(F.col("place") / BLOCK).alias("block"), "place", "successor").groupBy("path", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "successor"))).alias("links"))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts, ends = [], [], []
            for path, links in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs = links.values
                places, after = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                leads, _ = contracted(places, after)
                paths += [path] * len(places)
                starts.append(places)
                ends.append(leads)
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], names=["path", "place", "leads"])

    exits = written(blocks.select("path", "links").mapInArrow(contract, "path string, place long, leads long"), "warc-links")
    reached = exits.filter("place = 0").select("path", "place").distinct()
    jumps = exits.select("path", F.col("place").alias("from"), F.col("leads").alias("to"))
    known = written(reached, "warc-reached")
    have = known.count()
    while True:
        before = known
        further = known.join(jumps, (known.path == jumps.path) & (known.place == jumps["from"])).select(known.path, F.col("to").alias("place"))
        grown = written(known.union(further).distinct(), "warc-reached")
        now = grown.count()
        release(before)
        known = grown
        if now == have:
            break
        have = now
        earlier = jumps
        other = jumps.select(F.col("path").alias("p2"), F.col("from").alias("f2"), F.col("to").alias("t2"))
        jumps = written(jumps.join(other, (jumps.path == F.col("p2")) & (jumps["to"] == F.col("f2")), "left").select("path", "from", F.coalesce("t2", "to").alias("to")), "warc-jumps")
        if hasattr(earlier, "written_path"):
            release(earlier)
    release(exits)
    return known


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files below ``path``."""
    found = written(archive_records(spark, path), "warc-candidates")
    entries = reachable(found).withColumn("block", F.floor(F.col("place") / BLOCK))
    first = entries.groupBy("path", "block").agg(F.min("place").alias("entry"))
    chains = found.withColumn("block", F.floor(F.col("place") / BLOCK)).join(first, ["path", "block"])
    grouped = chains.groupBy("path", "block").agg(F.first("entry").alias("entry"), F.sort_array(F.collect_list(F.struct("place", "successor"))).alias("links"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, kept = [], []
            for name, entry, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                pairs = links.values
                follow = dict(zip(pairs.field(0).to_pylist(), pairs.field(1).to_pylist(), strict=True))
                at = entry
                while at in follow:
                    paths.append(name)
                    kept.append(at)
                    at = follow[at]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kept, pa.int64())], names=["path", "place"])

    kept = grouped.select("path", "entry", "links").mapInArrow(walk, "path string, place long")
    return found.join(kept, ["path", "place"], "left_semi")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages written as archives into the shared folder and read back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    found = read_archives(spark, path)
    out = written(found.drop("path", "place", "successor"), "warc-read")
    remove(spark, path)
    return out
