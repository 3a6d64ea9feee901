import time

import pytest

from corpusloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def nasty():
    fake = warc.record(99, "http://x", "inner", warc.digest(b"inner"), None) + warc.END
    return [(1, "u1", "same", "a"), (2, "u2", "same", "b"), (3, None, None, None), (4, "u\r\n4", "", None), (5, "u5", fake, None), (6, "u6", fake + fake, None),
            (7, "u7", "WARC/1.0\r\n", None), (8, "u8", "é" * 50 + "\r\n\r\n", None), (8, "u8", "other", None), (None, "u", "same", None), (0, "u0", fake * 40, None), (9, "u9", "\r\n\r\n\r\n", None)]


def expected(rows, min_bytes=0):
    keepers = {}
    for page, _, html, _ in rows:
        if page is not None and len((html or "").encode()) >= min_bytes:
            keepers[html or ""] = min(page, keepers.get(html or "", page))
    out = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        keeper = keepers.get(html or "") if len(body) >= min_bytes else None
        revisit = keeper is not None and keeper != page
        out.append((page, len(body), warc.digest(body), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip_rejects_magic_in_payloads(spark, min_bytes):
    rows = nasty()
    back = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(2), min_bytes)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=str) == expected(rows, min_bytes)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 700)
    rows = [(i, f"u{i}", f"payload {i} " * (i % 40) + ("WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" if i % 3 == 0 else ""), None) for i in range(120)]
    back = warc.round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=str) == expected(rows)


@pytest.mark.parametrize("bait", [b"WARC/1.0\r\nA: b\r\n", b"WARC/1.0\r\n", b"A: b\r\n", b"WARC/1.0\r\nContent-Length: 9999999999\r\n\r\n", b"WARC/1.0\r\nContent-Length: 7\r\n"])
def test_hostile_payloads_cost_no_more_than_others(bait):
    payload = (bait * (10_000_000 // len(bait))).decode()
    data = (warc.record(1, "u", payload, warc.digest(payload.encode()), None) + warc.END + warc.record(2, "u", "x", warc.digest(b"x"), None) + warc.END).encode()
    began = time.process_time()
    found = warc.candidates(data)
    assert time.process_time() - began < 5
    first = next(c for c in found if c[0] == 0)
    assert data[first[3] : first[1] - 4] == payload.encode()
    second = next(c for c in found if c[0] == first[1])
    assert second[1] == len(data)


def test_hostile_payloads_round_trip(spark):
    rows = [(k, "u", bait * 3000, None) for k, bait in enumerate(["WARC/1.0\r\nA: b\r\n", "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "WARC/1.0\r\nA:\r\n folded\r\n"])]
    back = warc.round_trip(spark.createDataFrame(rows, SCHEMA))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=str) == expected(rows)


def test_foreign_headers():
    block = b"WARC/1.0\r\nWARC-Type: response\r\nX_odd.1:v\r\nLong: a\r\n  b\r\nContent-Length: 3 \r\n\r\nabc\r\n\r\n"
    ((place, after, fields, body),) = warc.candidates(block)
    assert (place, after, block[body : after - 4], fields[b"long"], fields[b"x_odd.1"]) == (0, len(block), b"abc", b"a\r\n  b", b"v")
    assert warc.candidates(block.replace(b"Long: a", b"no header")) == []
