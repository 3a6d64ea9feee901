"""Compaction against a plain version that works on lists, and the bytes of the files before and after."""

import datetime
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from corpusloom.llm import compaction
from corpusloom.llm.queries import op11_compaction

FOLDER = "/root/testdata/sf0.001"
EPOCH = datetime.datetime(1970, 1, 1)


def plain(rows):
    """The final files by the words of the contract: key to (n_rows, ids, cents, sources, rewritten)."""
    share = lambda x: 1 + len(rows) // x
    day = lambda t: None if t is None else (t - EPOCH).days
    counts = defaultdict(int)
    for _, at, _ in rows:
        counts[day(at)] += 1
    files = defaultdict(list)
    for k, at, value in rows:
        h = zlib.crc32(b"" if k is None else str(k).encode())
        files[day(at), h // 16 % (1 + counts[day(at)] // share(200)), min(h % 4, h // 4 % 4)].append((at, k, value))
    first = datetime.datetime.min
    for key in files:
        files[key].sort(key=lambda r: (r[0] or first, r[1] is not None, r[1] or 0))
    out, groups = {}, defaultdict(list)
    for d, lot, piece in sorted(files, key=lambda f: (-len(files[f]), f[1], f[2])):
        mine = files[d, lot, piece]
        if len(mine) >= share(750):
            out[d, lot, piece] = [[(lot, piece)], mine]
            continue
        for group in groups[d]:
            if len(group[1]) + len(mine) <= share(400):
                group[0].append((lot, piece))
                group[1].extend(mine)
                break
        else:
            groups[d].append([[(lot, piece)], list(mine)])
    for d, made in groups.items():
        for group in made:
            out[d, *group[0][0]] = group
    cents = lambda v: 0 if v is None or not math.isfinite(v) else math.floor(100 * v + 0.5)
    return {
        key: (len(mine), ",".join("" if k is None else str(k) for _, k, _ in mine), sum(cents(v) for _, _, v in mine), ",".join(f"{a}-{b}" for a, b in names), len(names) > 1)
        for key, (names, mine) in out.items()
    }


def compare(got, rows):
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        n, ids, cents, sources, rewritten = want[r.day, r.lot, r.piece]
        assert (r.n_rows, r.cents, r.sources, r.rewritten) == (n, cents, sources, rewritten)
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        known = [int(x) for x in ids.split(",") if x]
        assert (r.min_click_id, r.max_click_id) == ((min(known), max(known)) if known else (None, None))
        held = pq.read_table(r.path.removeprefix("file://").removeprefix("file:"), partitioning=None)
        assert ",".join(held.column_names) == r.columns
        assert ",".join("" if x is None else str(x) for x in held["click_id"].to_pylist()) == ids
    return want


def data_files(folder):
    folder = folder.removeprefix("file://").removeprefix("file:")
    return {os.path.join(d, f): hashlib.sha256(open(os.path.join(d, f), "rb").read()).digest() for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_query_equals_plain(spark):
    rows = [(r.click_id, r.arrived_at, r.value) for r in spark.read.parquet(f"{FOLDER}/clicks.parquet").collect()]
    got = op11_compaction(spark, FOLDER).collect()
    want = compare(got, rows)
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())
    assert set(data_files(got[0].path[: got[0].path.index("/files/")] + "/files")) == {r.path.removeprefix("file://").removeprefix("file:") for r in got}


def test_odd_rows_hot_day_and_untouched_bytes(spark):
    draw = random.Random(5)
    start = datetime.datetime(1969, 12, 28)
    rows = []
    for k in range(4000):
        at = start + datetime.timedelta(days=3 if draw.random() < 0.4 else draw.randint(0, 40), seconds=draw.randint(0, 86399))
        rows.append((draw.choice([k, k, -k, draw.randint(0, 50)]), at, draw.choice([draw.random() * 100, None, -0.005, float("nan"), float("inf")])))
    rows += [(None, None, 1.0), (None, start, None), (7, None, 2.0), *rows[:200]]
    frame = spark.createDataFrame([(k, a, v, "x", 1, "y") for k, a, v in rows], "click_id long, arrived_at timestamp_ntz, value double, `__day` string, Lot int, `a.b` string").repartition(7)
    work = compaction.Compaction(frame)
    work.write()
    before = data_files(work.files)
    work.join()
    work.publish()
    work.publish()
    got = work.listing().collect()
    compare(got, rows)
    after = data_files(work.files)
    names = {r.path.removeprefix("file://").removeprefix("file:"): r for r in got}
    assert set(after) == set(names)
    for name, r in names.items():
        assert r.rewritten != (before.get(name) == after[name])
    assert len(before) > len(after)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "click_id long, arrived_at timestamp_ntz, value double")
    assert compaction.compacted(frame).count() == 0


def test_plan_takes_the_first_group_that_fits(spark):
    draw = random.Random(6)
    for n_rows in (900, 4000):
        sizes = [(d, lot, 0, f"f{lot}", draw.randint(1, 1 + n_rows // 750)) for d in range(3) for lot in range(40)]
        frame = spark.createDataFrame(sizes, "day long, lot long, piece long, path string, n_rows long")
        got = sorted((r.day, r.group, r.turn, r.lot) for r in compaction.plan(frame, n_rows).collect())
        want = []
        for d in range(3):
            groups = []
            for _, lot, _, _, n in sorted((s for s in sizes if s[0] == d and s[4] < 1 + n_rows // 750), key=lambda s: (-s[4], s[1])):
                g = next((g for g in groups if g[0] + n <= 1 + n_rows // 400), None)
                if g is None:
                    groups.append(g := [0, []])
                g[0] += n
                g[1].append(lot)
            want += [(d, i, j, lot) for i, g in enumerate(groups) for j, lot in enumerate(g[1])]
        assert got == sorted(want)
