"""Page, section and paragraph windows against a plain version, and the choice among chunkers."""

import random
import re

from corpusloom.operators import windows as w


def plain_windows(paras, target, overlap):
    chunks, now = [], []
    count = lambda p: len(p.split())
    for p in paras:
        if count(p) > target * 1.5:
            words = p.split()
            chunks += [" ".join(words[i : i + target]) for i in range(0, len(words), max(1, target - overlap))]
            continue
        if now and sum(map(count, now)) + count(p) > target:
            chunks.append("\n\n".join(now))
            kept = now[-1:] if overlap > 0 else []
            for q in reversed(now[:-1] if overlap > 0 else []):
                if sum(map(count, kept)) + count(q) > overlap:
                    break
                kept.insert(0, q)
            now = kept
        now.append(p)
    return chunks + (["\n\n".join(now)] if now else [])


def plain(text, target, overlap, drop):
    marks = list(re.finditer(r"\n\s*---\s*Page\s*(\d+)\s*---\s*\n", text, re.I))
    paged = [(int(m[1]), text[m.end() : (marks + [None])[i + 1].start() if i + 1 < len(marks) else len(text)].strip()) for i, m in enumerate(marks)] or [(1, text.strip())]
    out = []
    for number, page in paged:
        if not page:
            continue
        secs, title, body = [], None, []
        for line in [*page.split("\n"), None]:
            if line is None or re.match(w.SECTION_LINE, line):
                if title is not None and "\n".join(body).strip():
                    secs.append((title, "\n".join(body).strip()))
                title, body = (re.sub(r"\s+", " ", line.strip()), []) if line is not None else (None, [])
            else:
                body.append(line)
        for title, body in secs or [("page", page)]:
            if drop and title.lower() == "references":
                continue
            for chunk in plain_windows([p.strip() for p in re.split(r"\n\s*\n+", body) if p.strip()], target, overlap):
                out.append((f"{len(out) + 1:05d}|p{number}|{title[:30].strip()}", chunk))
    return out


def texts(draw):
    for _ in range(60):
        parts = []
        for _ in range(draw.randint(0, 14)):
            parts.append(draw.choice(["\n --- page 7 --- \n", "\n--- Page 12 ---\n", "Introduction", " results ", "References", "2.1 Some long numbered heading of a section here", "plain line"]) if draw.random() < 0.4
                         else " ".join(f"w{draw.randint(0, 9)}" for _ in range(draw.choice([1, 3, 5, 8, 12, 40]))))
        yield draw.choice(["\n", "\n\n", "\n \n"]).join(parts)


def test_custom_windows(spark):
    rows = [(k, t) for k, t in enumerate(texts(random.Random(5)))] + [(1000, None), (1001, ""), (1002, "one")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(4)
    for target, overlap, drop in ((10, 4, True), (6, 0, False)):
        got = {}
        for r in sorted(w.custom(docs, target, overlap, drop).collect(), key=lambda r: (r.id, r.chunk_no)):
            got.setdefault(r.id, []).append((r.chunk_id, r.chunk))
        for k, t in rows:
            assert got.get(k, []) == plain(t or "", target, overlap, drop), t
    assert w.custom(docs.limit(0)).collect() == []


def test_dispatch_takes_each_branch(spark):
    long = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(40)) for i in range(12))
    rows = [(1, f"Methods\n{long}", "sections"), (2, long, "sliding"), (3, f"\n--- Page 3 ---\n{long}\n--- Page 4 ---\n{long} model", "pages"), (4, long, " Custom "), (5, long, "other"), (6, long, None), (7, None, "pages")]
    found = w.dispatched(spark.createDataFrame(rows, "id int, text string, strategy string"), best=5, custom_words=(100, 45)).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.id, r.rank)):
        by.setdefault(r.id, []).append(r)
    assert {k: v[0].strategy for k, v in by.items()} == {1: "sections", 2: "sliding", 3: "pages", 4: "custom", 5: "fallback", 6: "fallback"}
    assert all(len(v) <= 5 and [r.rank for r in v] == list(range(1, len(v) + 1)) for v in by.values())
    assert [r.chunk_no for r in by[3]] == [2, 1]  # a priority word
    assert [r.chunk for r in by[4]] == [c for _, c in plain(long, 100, 45, True)][:5]
    assert [r.chunk for r in by[5]] == [r.chunk for r in by[6]]
