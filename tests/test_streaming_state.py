"""Keyed limits over several batches and restarts against the batch windows, and the cursor source over stops and restarts."""

import datetime
import json
import random

from pyspark.sql import functions as F

from corpusloom.sources.cursor import SCHEMA, CursorSource
from corpusloom.streaming import limits, usage

SCHEMA_EVENTS = "event_id long, user_id long, ts timestamp, tokens long, failed boolean"


def files(spark, folder, days):
    """A file of events a day, each read as a batch of its own; the moments of two files differ."""
    draw = random.Random(9)
    rows, start, k = [], datetime.datetime(2024, 1, 1), 0
    for day in range(days):
        mine = []
        at = start + datetime.timedelta(days=7 * day)
        for _ in range(60):
            at += datetime.timedelta(seconds=draw.choice([0, 1, 20, 59, 60, 61, 4000]))
            k += 1
            mine.append((k, draw.choice([1, 1, 2]), at, draw.randint(0, 90), draw.random() < 0.2))
        rows += mine
        spark.createDataFrame(mine, SCHEMA_EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return rows


def streamed(spark, folder, plan, out, cut):
    """Runs the plan one file a batch; with ``cut`` the query stops after each batch and starts again from its checkpoint."""
    events = spark.readStream.schema(SCHEMA_EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    plan(events).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(**({"once": True} if cut else {"availableNow": True})).start(out).awaitTermination()


def test_usage_over_batches_and_restarts(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = files(spark, folder, 8)
    m = limits.Limits(2, 100, 1_500, 6_000)
    ask = lambda e: usage.usage(e.select("event_id", "user_id", "ts", "tokens"), m)
    names = ["event_id", "tokens_minute", "tokens_day", "tokens_month", "allowed", "reason", "wait"]
    want = sorted(tuple(r) for r in limits.usage(spark.createDataFrame(rows, SCHEMA_EVENTS), m).select(names).collect())
    for cut in (False, True):
        out = str(tmp_path / f"usage-{cut}")
        for _ in range(8 if cut else 1):
            streamed(spark, folder, ask, out, cut)
        assert sorted(tuple(r) for r in spark.read.parquet(out).select(names).collect()) == want
    assert {r[5] for r in want} == {None, "month", "day", "tokens_minute", "requests_minute"}
    # the log holds no more than 30 days before the watermark and the sweeps' day
    state = spark.read.format("statestore").option("stateVarName", "log").load(str(tmp_path / "usage-False-state"))
    held = state.select("list_element.at")
    last = max(r[2] for r in rows)
    oldest = (last - datetime.timedelta(days=2 + 30 + 7 + 1)).timestamp() * 1_000_000
    assert held.count() < len(rows) and all(r.at >= oldest for r in held.collect())


def test_cooldowns_over_batches(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = files(spark, folder, 4)
    ask = lambda e: usage.cooldowns(e, "user_id", F.col("failed"), F.col("tokens") * 40, 600, 86400)
    frame = spark.createDataFrame(rows, SCHEMA_EVENTS)
    want = sorted(tuple(r) for r in limits.cooldowns(frame, "user_id", F.col("failed"), F.col("tokens") * 40, 600, 86400).select("event_id", "until", "blocked").collect())
    out = str(tmp_path / "cooldowns")
    streamed(spark, folder, ask, out, False)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    # a pause that the watermark has passed is forgotten: its end is null then, and blocks nothing either way
    assert [(e, b) for e, _, b in got] == [(e, b) for e, _, b in want]
    assert all(u == v or (u is None and not b) for (_, u, b), (_, v, _) in zip(got, want, strict=True))
    assert any(b for _, _, b in want)


def provider(folder, n, size):
    for page in range(-(-n // size)):
        at = folder / f"cursor={'first' if page == 0 else f'c{page}'}"
        at.mkdir(parents=True)
        following = f"c{page + 1}" if (page + 1) * size < n else None
        with open(at / "part-0.json", "w") as file:
            for i in range(page * size, min(n, (page + 1) * size)):
                file.write(json.dumps({"id": i, "title": f"t{i}", **({"next": following} if following else {})}) + "\n")


def drain(spark, source, out, batches, most=0):
    stream = spark.readStream.format("cursor_records").option("client", "corpusloom.sources.cursor.FolderClient").option("location", str(source)).option("per_page", 10).option("max_records", most).option("batch_pages", batches).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(processingTime="0 seconds").start(out)
    return query


def test_cursor_stream_stops_and_restarts(spark, tmp_path):
    spark.dataSource.register(CursorSource)
    provider(tmp_path / "pages", 95, 10)
    out = str(tmp_path / "out")
    # stopped as soon as a batch is through, and started again from the checkpoint
    for _ in range(12):
        query = drain(spark, tmp_path / "pages", out, 2)
        while query.isActive and not query.recentProgress:
            query.awaitTermination(0.05)
        query.stop()
    query = drain(spark, tmp_path / "pages", out, 2)
    query.processAllAvailable()
    query.stop()
    rows = spark.read.schema(SCHEMA).parquet(out).collect()
    assert sorted(r.id for r in rows) == list(range(95))
    assert {(r.id // 10, r.page) for r in rows} == {(p, p) for p in range(10)}
    assert {r.cursor for r in rows if r.page == 0} == {"*"}


def test_cursor_stream_bounds_and_empty_provider(spark, tmp_path):
    spark.dataSource.register(CursorSource)
    provider(tmp_path / "pages", 95, 10)
    (tmp_path / "none").mkdir()
    for source, most, want in ((tmp_path / "pages", 25, 30), (tmp_path / "none", 0, 0)):
        out = str(tmp_path / f"out-{want}")
        query = drain(spark, source, out, 3, most)
        query.processAllAvailable()
        query.stop()
        assert spark.read.schema(SCHEMA).parquet(out).count() == want


def test_cursor_stream_takes_few_batches_of_runs(tmp_path):
    from corpusloom.sources.cursor import CursorReader

    provider(tmp_path / "pages", 3000, 10)
    reader = CursorReader({"client": "corpusloom.sources.cursor.FolderClient", "location": str(tmp_path / "pages"), "per_page": "10", "batch_pages": "4"})
    at, batches, read = reader.initialOffset(), 0, []
    while at["cursor"] is not None:
        start, at = at, reader.latestOffset()
        runs = reader.partitions(start, at)
        read += [(r[0], r[3]) for run in runs for r in reader.read(run)]
        assert len(runs) <= 64
        batches += 1
    assert read == [(i, i // 10) for i in range(3000)]
    assert batches == 7  # 4, 8, ... 256 pages; batches of four would be 75
