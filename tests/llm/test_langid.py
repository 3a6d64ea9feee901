import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import langid


def corpus():
    draw = random.Random(9)
    kinds = {"xx": ["the", "ing", "tion", "er", "and"], "yy": ["sch", "über", "keit", "un", "ein"], "zz": ["eau", "que", "é", "oi", "le"]}
    rows = []
    for i in range(300):
        lang = draw.choice(list(kinds))
        rows.append((i, " ".join("".join(draw.choice(kinds[lang]) for _ in range(3)) for _ in range(draw.randint(5, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = langid.learn(docs.filter(~langid.held_out()))
    assert list(profiles) == ["xx", "yy", "zz"]
    odd = spark.createDataFrame([(900, None, 1), (901, "", 1), (902, "123 !?", 1), (904, "\U00010330\U00010331", 1), (903, "schüberkeit " * 9000, 1), (903, "THEINGTION", 1), (None, "eauque", 1)], "doc_id long, text string, score int")
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(odd, profiles).collect()}
    assert got[900, "und"] == got[901, "und"] == got[902, "und"] == 0
    assert (904, "und") not in got
    assert (903, "yy") in got and (903, "xx") in got and (None, "zz") in got
    judged = langid.identify(docs, profiles).join(docs, "doc_id").filter(langid.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert judged > 0.98


def string_profile(text, size):
    """Brute force over strings: the most frequent n-grams, equal ones by code points, longer after none."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for w in words:
        counts.update(w)
        counts.update(a + b for a, b in zip(f" {w} ", f"{w} "))
        counts.update(a + b + c for a, b, c in zip(f" {w} ", f"{w} ", f"{w} "[1:]))
    order = lambda g: [0 if c == " " else ord(c) for c in g] + [1 << 30] * (3 - len(g))
    return sorted(counts, key=lambda g: (-counts[g], order(g)))[:size]


def test_profiles_equal_counting_of_strings():
    draw = random.Random(3)
    alphabet = "ab  \u00e9\u0434\u4e2d\U00010330\U00020000\U0001d400.9"
    texts = ["Ab ab, abc!", "", "zzz y", "\U00010330\U00010331", *("".join(draw.choice(alphabet) for _ in range(draw.randint(0, 400))) for _ in range(40))]
    for size in (5, 300):
        row, gram, rank, letters = langid.ranked(texts, size)
        for i, text in enumerate(texts):
            got = gram[row == i]
            assert rank[row == i].tolist() == list(range(len(got)))
            assert [langid.gram_text(int(g)) for g in got] == string_profile(text, size)
            assert letters[i] == any(c.isalpha() for c in text.lower())


def test_keys_tell_lengths_apart():
    grams = ["sh", " th", "th ", "h", "hh", "hhh", "\U0010fffd"]
    assert len({langid.gram_code(g) for g in grams}) == len(grams)
    assert [langid.gram_text(langid.gram_code(g)) for g in grams] == grams


def test_many_letters_are_split_into_runs():
    texts = ["".join(chr(0x4E00 + k) for k in range(20000)), "abc", "".join(chr(0x20000 + k) for k in range(30000))] * 3
    row, gram, _, letters = langid.ranked(texts, 50)
    assert letters.all()
    for i, text in enumerate(texts):
        assert [langid.gram_text(int(g)) for g in gram[row == i]] == string_profile(text, 50)


def test_distances_equal_brute_force():
    draw = random.Random(5)
    profiles = {name: string_profile("".join(draw.choice(letters) for _ in range(900)), langid.PROFILE) for name, letters in (("aa", "abcd "), ("bb", "cdef "), ("cc", "efab "))}
    texts = ["".join(draw.choice("abcdef ") for _ in range(draw.randint(1, 200))) for _ in range(30)] + ["\U00010330\U00010331"]
    names, score = langid.judge(texts, langid.rank_table(profiles, langid.PROFILE))
    for text, name, value in zip(texts, names, score):
        own = string_profile(text, langid.PROFILE)
        far = {k: sum(abs(p.index(g) - r) if g in p else langid.PROFILE for r, g in enumerate(own)) for k, p in profiles.items()}
        ordered = sorted(far, key=lambda k: (far[k], k))  # equal distances: the first name
        assert name == (ordered[0] if own else "und")
        assert not own or abs(value - (1 - far[ordered[0]] / far[ordered[1]] if far[ordered[1]] else 0)) < 1e-9


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.learn(docs) == {}
    assert [r.lang_pred for r in langid.identify(docs, {}).collect()] == ["und"]
    assert langid.identify(docs.limit(0), {}).count() == 0
