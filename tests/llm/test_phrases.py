import random
import re
from collections import Counter

import pytest
from lacewing.llm import phrases
from pyspark.sql import functions as F

SCHEMA = "lang string, text string"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def counted(rows, max_words):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    return f, n


def brute(rows, max_words=5, least=100, top=2000):
    f, n = counted(rows, max_words)
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= least:
            found[lang, words] = (a, *min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))))
    inside = lambda s, w: any(w[i : i + len(s)] == s for i in range(len(w) - len(s) + 1))
    kept = {x: v for x, v in found.items() if not any(y[0] == x[0] and len(y[1]) > len(x[1]) and o[0] >= v[0] and inside(x[1], y[1]) for y, o in found.items())}
    out = []
    for lang in n:
        own = sorted(((s, a, " ".join(w).encode(), l, r) for (g, w), (a, s, _, l, r) in kept.items() if g == lang), key=lambda x: (-x[0], -x[1], x[2]))
        out += [(lang, i, p.decode(), a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(own[:top], 1)]
    return sorted(out)


def got(df, **how):
    out = phrases.collocations(df, **how)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out.collect())


def texts(seed, count):
    rng = random.Random(seed)
    words = ["new", "York", "NEW", "é", "of", "the", "a.b", "ünd", "x", "z" * 90, "city"]
    line = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\x0b", "? ", "\x85"]) for _ in range(rng.randint(0, 30)))
    fixed = ["state of the art", "State  of the\tart", "New York city hall", "", None, "..", "one"]
    return [(rng.choice(["en"] * 5 + ["und", None, "dé"]), rng.choice([line(), *fixed])) for _ in range(count)]


@pytest.mark.parametrize("least, top, max_words", [(3, 2000, 5), (6, 4, 3), (2, 7, 2)])
def test_against_brute_force(spark, least, top, max_words):
    rows = texts(least, 400) + [("en", "state of the art " * 2000), ("lone", None), ("en", "New York " * 90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, least=least, top=top, max_words=max_words) == brute(rows, max_words, least, top) != []


def test_steps_and_a_full_bitmap_lose_nothing(spark, monkeypatch):
    rows = texts(1, 500)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = brute(rows, least=4)
    for bytes_, bits in ((200, 1 << 20), (8 << 20, 1 << 15)):
        monkeypatch.setattr(phrases, "COUNTED_BYTES", bytes_)
        monkeypatch.setattr(phrases, "LEAST_BITS", bits)
        monkeypatch.setattr(phrases, "MOST_BITS", bits)
        assert got(df, least=4) == want


def test_counts_are_of_marked_phrases_only(spark):
    rows = [("en", "a b c"), ("en", "a b d"), ("en", "e f g")]
    kept = phrases.phrase_counts(spark.createDataFrame(rows, SCHEMA), 3, 2).collect()
    assert sorted((r.n, r.phrase, r.a) for r in kept) == [(0, "", 9), (1, "a", 2), (1, "b", 2), (2, "a b", 2)]


def test_long_products_are_exact(spark):
    a, n = 9_007_199_254_740_993, 99_999_999_999_999_999
    counts = spark.createDataFrame([("x", 0, "", n), ("x", 1, "p", a), ("x", 1, "q", a + 2), ("x", 2, "p q", a)], "lang string, n int, phrase string, a long")
    row = phrases.scored(counts).first()
    assert (row.score, row.k, row.l, row.r) == (1000 * a * n // (a * (a + 2)), 1, a, a + 2)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame(texts(2, 300), SCHEMA)
    assert got(df.limit(0), least=2) == []
    more = df.withColumns({"n": F.lit(1), "phrase": F.lit("x"), "rank": F.lit(2)}).withColumn("a.b", F.lit(3))
    assert got(more, least=4) == got(df, least=4)
