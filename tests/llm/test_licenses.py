import random
import re

from paperloom.llm import license_scan as L


def cut(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(rows, templates, containment=0.75):
    out = {}
    for i, t in rows:
        w = cut(t)
        placed = [(n, tuple(w[n:n + 3])) for n in range(len(w) - 2)]
        for k, v in templates.items():
            x = cut(v)
            want = {tuple(x[n:n + 3]) for n in range(len(x) - 2)}
            width = 1
            while width < len(want):
                width *= 2
            for win in {n // width for n, _ in placed} | {n // width - 1 for n, _ in placed}:
                held = {s for n, s in placed if win * width <= n < (win + 2) * width}
                share = len(held & want) / len(want)
                if share >= containment:
                    out.setdefault((i, k), {})[win] = share
    whole = {k: dict(v) for k, v in out.items()}
    for a, b in L.rivals(templates, containment):
        for i in {i for i, k in out if k == a}:
            for win, share in list(out[i, a].items()):
                if whole.get((i, b), {}).get(win, 0) > share:
                    del out[i, a][win]
    out = {k: v for k, v in out.items() if v}
    return sorted(((i, k, max(v.values()), len(v)) for (i, k), v in out.items()), key=repr)


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = ["".join(rng.choice("etaoin") for _ in range(4)) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(list(L.NOTICES.values())).split(" ")
            for _ in range(rng.randint(0, len(w) // 10 + 1)):
                w[rng.randrange(len(w))] = "changed"
            words[len(words) // 2:len(words) // 2] = w
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words).swapcase() if i % 2 else " ".join(words)))
    return rows + [(90, None), (91, ""), (92, "Released under the MIT License " * 3000), (None, L.NOTICES["MIT"])]


def test_equals_brute_force(spark):
    rows = corpus()
    got = L.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license_id string")).collect()
    assert sorted(((r.doc_id, r.license_id, r.containment, r.n_windows) for r in got), key=repr) == brute(rows, L.NOTICES)
    assert len(got) > 30


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, L.NOTICES["GPL-3.0"])] * 3, "doc_id long, text string")
    assert [tuple(r)[:2] for r in L.scan_licenses(df).collect()] == [(1, "GPL-3.0")]
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_versions_of_a_license_are_told_apart(spark):
    """The version that a text names wins over its rivals; notices of both versions in one text are both found."""
    two, three = L.NOTICES["GPL-2.0"], L.NOTICES["GPL-3.0"]
    rows = [(1, two), (2, three), (3, f"{two}. {three}."), (4, L.NOTICES["LGPL-2.1-notice"]), (5, L.NOTICES["GPL-2.0-notice"]), (6, L.NOTICES["AGPL-3.0-notice"]), (7, L.NOTICES["ISC-notice"])]
    got = {}
    for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    assert got == {1: {"GPL-2.0"}, 2: {"GPL-3.0"}, 3: {"GPL-2.0", "GPL-3.0"}, 4: {"LGPL-2.1-notice"}, 5: {"GPL-2.0-notice"}, 6: {"AGPL-3.0-notice"}, 7: {"ISC-notice"}}


def test_short_and_empty_template_lists(spark):
    df = spark.createDataFrame([(1, "two words here and there"), (None, "two words here")], "doc_id long, text string")
    assert L.scan_licenses(df, {}).collect() == [] and L.scan_licenses(df, {"x": "two words", "y": ""}).collect() == []
    got = L.scan_licenses(df, {"x": "two words", "y": "two words here"}).collect()
    assert sorted(map(str, [(r.doc_id, r.license_id) for r in got])) == ["(1, 'y')", "(None, 'y')"]
