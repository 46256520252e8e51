import re
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import collocations as C


def brute(rows, top=2000, least=10):
    f = [Counter(), Counter(), Counter()]
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f[size - 1].update((lang or "und", *words[i:i + size]) for i in range(len(words) - size + 1))
    n = Counter()
    for (lang, _), c in f[0].items():
        n[lang] += c
    longer = Counter()
    for (lang, x, y, z), c in f[2].items():
        if c >= least:
            longer[lang, x, y], longer[lang, y, z] = max(longer[lang, x, y], c), max(longer[lang, y, z], c)
    out = {}
    for size in (2, 3):
        for key, a in f[size - 1].items():
            if a < least or size == 2 and longer[key] and 100 * longer[key] >= 50 * a:
                continue
            lang, w = key[0], key[1:]
            cuts = [(10**6 * a * a // (f[k - 1][lang, *w[:k]] * f[size - k - 1][lang, *w[k:]]), k) for k in range(1, size)]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[k - 1][lang, *w[:k]], f[size - k - 1][lang, *w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "THE", "x" * 300]
    weight = 1 / np.arange(1, len(words) + 1)
    fixed = ["new york city", "New York times", "as well as", "Sine qua non", "ß ü"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(0, 12)):
            parts.append(" ".join(rng.choice(words, rng.integers(1, 9), p=weight / weight.sum())) if rng.random() < 0.6 else fixed[rng.integers(len(fixed))])
            parts.append([" ", ", ", ". ", "\n", "\t", "!?", "  "][rng.integers(7)])
        rows.append(("".join(parts), ["en", "de", None, "und", "xx"][rng.integers(5)]))
    return rows + [(None, "en"), ("", "fr"), ("alone", "fr"), (" ".join(["hot pair"] * 5000), "en")] + rows[:30]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, t, g, "x", 0) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, hash string, n int").repartition(4)
    return sorted(tuple(r) for r in C.mine_collocations(df, **more).collect())


@pytest.mark.parametrize("top, bits", [(2000, 24), (15, 24), (15, 6)])
def test_equals_brute_force(spark, top, bits):
    """Also with so short a list that growth ends early, and with bitmaps that hold back nothing."""
    rows = corpus(1, 500)
    want = brute(rows, top)
    assert mined(spark, rows, top=top, bits=bits) == want and len(want) > 40


def test_ties_at_the_end_of_the_list(spark):
    rows = [(f"left{i} right{i}. " * 10, "en") for i in range(40)]
    got = mined(spark, rows, top=25)
    assert got == brute(rows, 25) and {r[-1] for r in got} == {10**6}


def test_growth_stops_before_everything_is_counted(spark, monkeypatch):
    rows = [(f"top{i} pair{i}. " * 10, "en") for i in range(60)] + [("a b c. a c b. b a c. c a. a a. c b a. " * 40, "en")]
    grown = []
    count = C._counted
    monkeypatch.setattr(C, "_counted", lambda t, size, *a: grown.append(size) or count(t, size, *a))
    assert mined(spark, rows, top=5) == brute(rows, 5) and grown.count(3) == 1


def test_colliding_words_start_anew(spark, monkeypatch):
    rows = corpus(2, 200)
    real, seeds = C._words, []

    def collide(seed):
        seeds.append(seed)
        run = real(seed)

        def same(batches):
            import pyarrow as pa
            for b in run(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([7] * len(b), pa.int64()), b.column(3)], b.schema.names)
        return same if seed == 0 else run
    monkeypatch.setattr(C, "_words", collide)
    assert mined(spark, rows) == brute(rows) and seeds == [0, 1]


def test_empty_table(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_counts_whose_products_pass_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000_000, 4_000_000_000_000_000, 5_000_000_000_000_000)], "a long, l long, r long")
    assert df.select(C._score("a", "l", "r").alias("s")).first().s == 10**6 * 9 // 20
