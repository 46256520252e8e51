import random

from paperloom.llm import line_dedup


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    s, d = sorted((a, b), key=len)
    return any(d[:i] + d[i + 1:] == s for i in range(len(d)))


def brute(rows, chars=20):
    lines = sorted(((i, n, x.strip(" \t\r")) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))), key=lambda r: (r[0] is not None, r))
    first, out = {}, []
    for i, n, x in lines:
        if x:
            first.setdefault(x, (i, n))
    rank = lambda p: (p[0] is not None, p)
    near = {}
    for x, p in first.items():
        for y, q in first.items():
            if rank(q) < rank(p) and min(len(x), len(y)) >= chars and within_one(x, y):
                near[x] = min(near.get(x, q), q, key=rank)
    for i, n, x in lines:
        m = None if not x else near.get(x) or (first[x] if first[x] != (i, n) else None)
        out.append((i, n, m is None, m and m[0], m and m[1], None if m is None else int(x in near)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(9)
    rows = []
    bases = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (3, 18, 19, 20, 21, 40, 41, 300, 700, 2500)] + ["Page number and such, part 1 of 9"]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(x) + 1)
                x[at:at + rng.choice([0, 1])] = rng.choice([[], ["z"], ["y"]])
            lines.append(rng.choice(["", " "]) + "".join(x) + rng.choice(["", "\r", " "]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " \t\n"), (None, bases[5])]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string").repartition(3)
    got = sorted((tuple(r) for r in line_dedup.line_verdicts(df).collect()), key=repr)
    assert got == brute(rows)
    assert any(r[5] == 1 for r in got)


def test_many_neighbours_of_one_line(spark):
    """A hot deletion variant: every line is within one edit of every other."""
    rows = [(i, f"A line that differs in one place only: {chr(0x4E00 + i)} end") for i in range(400)]
    got = line_dedup.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept, r.match_doc_id) for r in got} == {(0, True, None)} | {(i, False, 0) for i in range(1, 400)}


def test_texts_without_their_repeated_lines(spark):
    same = "The same sentence stands in every text here."
    rows = [(1, f"{same}\nfirst text\n", "k1"), (2, f"{same}\n\nsecond text", "k2"), (3, same, "k3"), (4, None, "k4"), (5, "", "k5"), (6, f"own\n{same[:-1]}!", "k6"), (None, "null id", "k7")]
    for name in ("_drop", "drop", "row", "kept", "line_no", "rest"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
        out = line_dedup.dedup_lines(df)
        assert out.columns == df.columns
        got = {r.doc_id: (r.text, r[name]) for r in out.collect()}
        assert got == {1: (f"{same}\nfirst text\n", "k1"), 2: ("\nsecond text", "k2"), 4: (None, "k4"), 5: ("", "k5"), 6: ("own", "k6"), None: ("null id", "k7")}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_are_judged_apart(spark, tmp_path):
    """Null ids, one id for two texts, and repeated rows: each row loses its own repeated lines only."""
    rows = [(None, "first of all\nunique one"), (None, "first of all\nunique two"), (7, "seven a\nfirst of all"), (7, "seven b\nseven a\nseven c"), (9, "twice the same row"), (9, "twice the same row")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    got = sorted(map(repr, (tuple(r) for r in line_dedup.dedup_lines(spark.read.parquet(f"{tmp_path}/t")).collect())))
    assert got == sorted(map(repr, [(None, "first of all\nunique one"), (None, "unique two"), (7, "seven a"), (7, "seven b\nseven c"), (9, "twice the same row")]))
