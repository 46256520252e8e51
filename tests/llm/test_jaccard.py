import random
import re

import pytest

from paperloom.llm import components, jaccard

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and None not in (sets[x][0], sets[y][0]) and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s), None if i is None else least[find(x)]) for x, (i, s) in enumerate(sets)), key=repr)


def corpus(seed):
    """Copies, near copies at every distance around the threshold, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                at = rng.randrange(len(w))
                w[at:at + rng.choice([0, 1])] = [word()]
            if rng.random() < 0.3:
                w[3:3] = passage
            rows.append((n, rng.choice([" ", "\n", "  "]).join(w)))
            n += 1
    rows += [(n, "One two"), (n + 1, "one TWO"), (n + 2, "one"), (n + 3, ""), (n + 4, None), (n + 5, " \n\t"), (n + 6, "É é É é É"), (n + 7, "é é é é é")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard.jaccard_join(df).rows.collect()), key=repr)
    assert got == brute(rows)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, text + " end", None), (7, "other words entirely here now", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in jaccard.jaccard_join(df).rows.collect()), key=repr)
    assert got == sorted([(1, 36, 1), (1, 36, 1), (None, 36, None), (2, 37, 1), (7, 1, 7)], key=repr)


def test_empty_table(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).rows.count() == 0


def test_links_carry_exact_overlaps(spark):
    base = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:-1] + ["x"])), (3, " ".join(base[10:]))], "doc_id long, text string")
    links = jaccard.jaccard_join(df).links.collect()
    assert {r.overlap for r in links} <= {55, 46, 45} and links


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(300)] + [(5, 5), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100} | {200 + i: 100 for i in range(300)} | {900: 900, 901: 900}
    assert got == want


def brute_links(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    return [(x, y) for x in range(len(sets)) for y in range(x) if sets[x][1] and sets[y][1] and None not in (sets[x][0], sets[y][0])
            and 100 * len(sets[x][1] & sets[y][1]) >= percent * len(sets[x][1] | sets[y][1])]


@pytest.mark.parametrize("seed", range(2))
def test_every_link_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    rows += [(1000 + i, " ".join(base[:i] + ["changed"] + base[i + 1:])) for i in range(0, 120, 4)]  # all near one another
    rows += [(2000, rows[-1][1]), (2001, rows[-1][1].upper()), (None, rows[-1][1])]
    want = brute_links(rows)
    linked = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), every_link=True)
    count = {}
    for x, y in want:
        for z in (x, y):
            count[rows[z][0]] = count.get(rows[z][0], 0) + 1
    assert {r.doc_id: r.n_links for r in linked.rows.collect()} == {i: count.get(i, 0) for i, _ in rows}
    different = sorted(tuple(sorted((rows[x][0], rows[y][0]))) for x, y in want if shingles(rows[x][1]) != shingles(rows[y][1]))
    assert sorted(tuple(sorted(p)) for p in jaccard.document_pairs(linked).collect()) == different
    assert sorted((tuple(r)[:3] for r in linked.rows.collect()), key=repr) == brute(rows)


def test_every_link_of_repeated_rows_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (2, text + " end"), (7, "other words entirely here now")]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), every_link=True).rows.collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == [(1, 2), (1, 2), (2, 2), (7, 0), (None, 0)]
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string"), every_link=True).rows.count() == 0


def test_texts_just_below_the_threshold_give_no_rows_but_candidates(spark, monkeypatch):
    """A group whose texts share most shingles, none linked to most others: each pair is met at most once, and only if
    no bound rules it out."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for at in range(rng.randrange(21), 150, 21):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    tables = {}
    real = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: tables.setdefault(name, real(df, name)))
    got = sorted((tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).rows.collect()), key=repr)
    assert got == brute(rows)
    pairs = [tuple(sorted((r.a, r.b))) for r in tables["cross-pairs"].collect()]
    assert len(pairs) == len(set(pairs)) and len(pairs) < 260 * 259 / 2 / 20
