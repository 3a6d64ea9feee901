import random
from datetime import datetime, timedelta

from corpusloom.llm import urlfilter

START = datetime(2024, 1, 1)


def test_as_of_join_equals_brute_force(spark):
    draw = random.Random(4)
    domains = ["a.com", "x.a.com", "y.x.a.com", "b.org", "com", "c.net"]
    entries = [(draw.choice(domains), draw.choice(["block", "allow", "drop"]), START + timedelta(hours=draw.randint(0, 40))) for _ in range(40)]
    entries += [(None, "block", START), ("b.org", None, START), ("b.org", "block", None), ("B.org", "allow", START)]
    urls = ["http://a.com/p", "https://u:p@X.a.com:80/q?r", "ftp://y.x.a.com", "http://b.org#f", "nourl", None, "http://z.c.net/", "http://acom"]
    captures = [(i % 150, draw.choice(urls), START + timedelta(minutes=draw.randint(0, 3000)) if i % 17 else None, "extra") for i in range(300)]
    captures += captures[:3]
    got = urlfilter.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, host string"), spark.createDataFrame(entries, "domain string, action string, listed_at timestamp"))
    held = {}
    for d, a, t in entries:
        if d and a and t:
            held.setdefault(d.lower(), {}).setdefault(t, []).append(a)
    want = []
    for page, url, at, _ in captures:
        host = url.split("://")[1].split("/")[0].split("#")[0].split("@")[-1].split(":")[0].lower() if url and "://" in url else ("" if url else None)
        best = None
        labels = (host or "").split(".")
        for i in range(len(labels)):
            domain = ".".join(labels[i:])
            past = [t for t in held.get(domain, {}) if at and t <= at]
            if past and best is None:
                action = min(held[domain][max(past)])
                if action != "drop":
                    best = (domain, max(past), action == "block")
        want.append((page, url, at, host, *(best or (None, None, False))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_list_and_table(spark):
    none = spark.createDataFrame([], "domain string, action string, listed_at timestamp")
    some = spark.createDataFrame([(1, "http://a.b/", START)], "page_id long, url string, fetched_at timestamp")
    assert [r.blocked for r in urlfilter.evaluate(some, none).collect()] == [False]
    assert urlfilter.evaluate(some.limit(0), none).count() == 0
