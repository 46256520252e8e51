import random

from paperloom.llm import decontaminate as D


def edit_search(item, text):
    """Least edit distance of item to any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d))
    return min(row)


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s))
        s[at:at + rng.choice([0, 1])] = rng.choice([[], ["z"], ["q"]])
    return "".join(s)


def corpus():
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    items = [(i, text(rng.randint(3, 45))) for i in range(12)] + [(50, "x"), (51, " \n"), (52, None), (53, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")]
    docs = []
    for i in range(80):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            parts += [edited(rng, rng.choice(items[:12])[1], rng.randint(0, 12)).upper().replace(" ", rng.choice([" ", "\n", "  "])), text(rng.randint(0, 20))]
        docs.append((i, " ".join(parts)))
    docs += [(90, None), (91, ""), (92, "a" * 3000), (None, "see " + items[3][1]), (93, items[3][1]), (93, items[3][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    got = D.find_items(spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, t in docs:
        for i, x in items:
            x = D.normalise(x)
            if x and (e := edit_search(x, D.normalise(t))) <= D.budget(len(x), 0.05):
                want.append((d, i, e))
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.edits for r in got} > {0, 1, 2}


def test_blocks_of_items_and_filter(spark, monkeypatch):
    docs, items = corpus()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.find_items(docs, items).collect()), key=repr)
    left = {r.doc_id for r in D.decontaminate(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {w[0] for w in whole}
    monkeypatch.setattr(D, "ITEM_BYTES", 500)
    assert sorted(map(tuple, D.find_items(docs, items).collect()), key=repr) == whole


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "text")], "doc_id long, text string"), spark.createDataFrame([(1, "text")], "item_id long, text string")
    assert D.find_items(docs.limit(0), items).count() == 0 and D.find_items(docs, items.limit(0)).count() == 0
    assert D.find_items(docs, items).count() == 1


def test_rows_that_share_a_doc_id_are_judged_apart(spark, tmp_path):
    item = "an item of the benchmark that is long enough to be found in texts"
    rows = [(None, f"holds {item} indeed", 1), (None, "clean without id", 2), (None, None, 3), (4, f"{item}", 4), (4, "clean", 5), (4, "clean", 5)]
    for name in ("_leak", "row", "kept", "key"):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, f"doc_id long, text string, {name} int").coalesce(1).write.parquet(path)
        docs = spark.read.parquet(path)
        out = D.decontaminate(docs, spark.createDataFrame([(1, item), (2, None), (None, "clean")], "item_id long, text string"))
        assert out.columns == docs.columns and sorted(r[name] for r in out.collect()) == [2, 3, 5, 5]
    assert D.decontaminate(docs.limit(0), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0
