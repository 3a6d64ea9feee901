import base64
import hashlib
import math
from collections import Counter

import numpy as np

from corpusloom.llm import fingerprints as fp


def test_entropy_equals_its_definition():
    data = np.frombuffer(np.random.default_rng(1).integers(97, 110, 400, dtype=np.uint8).tobytes() + b"a" * 100, np.uint8)
    starts = np.arange(0, 436, 7)
    for s, level in zip(starts, fp.window_entropy(data, starts), strict=True):
        counts = Counter(data[s : s + fp.WINDOW].tolist()).values()
        bits = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in counts)
        assert abs(level - 1000 * bits / math.log2(fp.WINDOW)) <= 0.51


def test_sliding_argmin():
    keys = np.random.default_rng(2).integers(0, 5, 100)
    got = fp.sliding_argmin(keys, 16)
    assert got.tolist() == [i + int(keys[i : i + 16].argmin()) for i in range(85)]


def texts():
    draw = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(800)]
    out = [(i * 3, " ".join(draw.choice(words, int(draw.integers(1, 300))))) for i in range(60)]
    return [*out, (500, None), (501, ""), (502, "kurz"), (503, "é" * 200), (503, "é" * 200), (504, out[5][1]), (505, "x " * 40_000), (None, "no id")]


def test_edited_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    table = fp.rarity_table(docs)
    got = fp.edited_fingerprints(docs, table).collect()
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(ordered):
        n = ordered[(i + 1) % len(ordered)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = fp.digests([t, e, n], table)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.text(), b.text(), fp.likeness(a, b), fp.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 800 and r.doc_id not in (505,)]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs, table).collect()}
    assert prints[504] == prints[15] and prints[500] == prints[501] == "0:"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fingerprint string")
    assert fp.edited_fingerprints(docs, fp.rarity_table(docs)).count() == 0


def test_texts_without_blanks_are_read_to_their_end():
    draw = np.random.default_rng(4)
    table = np.arange(fp.LEVELS)
    head = "".join(chr(0x4E00 + c) for c in draw.integers(0, 3000, 400))
    tails = ["".join(chr(0x4E00 + c) for c in draw.integers(0, 3000, 400)) for _ in range(2)]
    a, b = fp.digests([head + t for t in tails], table)
    assert a.text() != b.text() and 0.2 < fp.likeness(a, b) < 0.9
    plain, edited = fp.digests([head, head[:200] + tails[0][:200]], table)
    assert fp.likeness(plain, edited) < 1
    for text in ("é" * 200, "x " * 400, "ab" * 40, "q" * 79, "".join(chr(97 + c) for c in draw.integers(0, 26, 80))):
        assert fp.digests([text], table)[0].count > 0


def test_entropy_of_a_window_does_not_depend_on_its_place():
    data = np.random.default_rng(5).integers(97, 105, 2 * fp.BLOCK + 500).astype(np.uint8)
    whole = fp.entropy_levels(data)
    for at in (0, 17, fp.BLOCK - 3, fp.BLOCK, 2 * fp.BLOCK + 400):
        assert np.array_equal(whole[at : at + 37], fp.entropy_levels(data[at : at + 100])[:37])


MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def plain_hash(data):
    """The polynomial hash and its finaliser in plain integers."""
    x, power = 0, 1
    for byte in data:
        x = (x + (byte + 1) * power) & MASK
        power = power * BASE & MASK
    x = (x + len(data) * 0xD6E8FEB86659FD93) & MASK
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_level(window):
    total = sum(round(2**32 * c * math.log2(c)) for c in Counter(window).values())
    return round(1000 - total * (1000 / round(2**32 * 64 * 6)))


def plain_features(data, rarity):
    if len(data) < 64:
        return [plain_hash(data)] if data else []
    windows = [data[i : i + 64] for i in range(len(data) - 63)]
    hashes = [plain_hash(w) for w in windows]
    if len(windows) < 16:
        return hashes
    key = [(int(rarity[plain_level(w)]), h >> 50) for w, h in zip(windows, hashes)]
    votes = Counter(min(range(i, i + 16), key=lambda j: (key[j], j)) for i in range(len(windows) - 15))
    chosen = {i for i, n in votes.items() if n >= 6}
    chosen |= {i for i, n in votes.items() if n < 6 and any(i + d < len(hashes) and hashes[i] == hashes[i + d] for d in range(1, 16))}
    return [hashes[i] for i in sorted(chosen or votes)]


def plain_digest(data, rarity):
    """Number of distinct features and the set bits of each filter."""
    kinds = list(dict.fromkeys(plain_features(data, rarity)))
    filters = [{(h >> (11 * j)) & 2047 for h in kinds[at : at + 160] for j in range(5)} for at in range(0, len(kinds), 160)]
    return len(kinds), filters


def plain_text(digest):
    raw = b"".join(sum(1 << b for b in bits).to_bytes(256, "little") for bits in digest[1])
    return f"{digest[0]}:{base64.b64encode(raw).decode()}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    if len(a[1]) > len(b[1]):
        a, b = b, a
    sizes = lambda d: [min(160, d[0] - 160 * i) for i in range(len(d[1]))]
    total = 0.0
    for bits, n in zip(a[1], sizes(a)):
        best = 0.0
        for other, m in zip(b[1], sizes(b)):
            stay = lambda k: (1 - 1 / 2048) ** (5 * k)
            chance = 2048 * (1 - stay(n) - stay(m) + stay(n + m))
            most = min(len(bits), len(other))
            least = chance + 0.3 * (most - chance)
            best = max(best, min(1, max(0, (len(bits & other) - least) / max(most - least, 1e-9))) if most > least else 0.0)
        total += n * best
    return total / sum(sizes(a))


def test_digests_and_likeness_equal_a_plain_version():
    draw = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, 5)) for _ in range(200)]
    some = [" ".join(draw.choice(words, n)) for n in (1, 9, 14, 40, 400, 700)]
    some += ["", "short", "ab" * 60, "x" * 300, "日本語" * 50, some[4][:1000] + some[5][:900], some[4]]
    rarity = np.random.default_rng(7).permutation(fp.LEVELS)
    got, want = fp.digests(some, rarity), [plain_digest(t.encode(), rarity) for t in some]
    assert [d.text() for d in got] == [plain_text(d) for d in want]
    for i in range(len(some)):
        for j in range(len(some)):
            assert abs(fp.likeness(got[i], got[j]) - plain_likeness(want[i], want[j])) < 1e-9


def test_ids_that_are_no_integers_go_in_their_order(spark):
    rows = [(f"k{i:02d}", f"text number {i} " * (i + 1)) for i in range(30)] + [("", "none"), ("k05", "again")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {(r.doc_id, r.n_chars): r.edited_sha256 for r in fp.edited_fingerprints(docs, fp.rarity_table(docs)).collect()}
    ordered = sorted(rows)
    for i, (d, t) in enumerate(ordered):
        n = ordered[(i + 1) % len(ordered)][1]
        assert got[d, len(t)] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
