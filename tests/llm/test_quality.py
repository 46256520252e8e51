import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import quality


def corpus(n=500):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(8, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"s{i % 3}", len(text), float(i)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_identity_equals_the_double_sum():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES).astype(np.float32), rng.normal(size=(quality.FEATURES, 4)).astype(np.float32))
    ids, x = rng.choice(quality.FEATURES, 12, replace=False), rng.random(12).astype(np.float32)
    want = 0.3 + m.linear[ids] @ x + sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert abs(m.margins(ids, x, np.array([0, 12]))[0] - want) < 1e-3


def test_blocks_do_not_change_features(monkeypatch):
    texts = pa.array([t for _, t, *_ in corpus(60)[0]] + [None, "", " ", "é"])
    n = np.full(len(texts), 7)
    whole = list(quality.features(texts, n))
    monkeypatch.setattr(quality.W, "BLOCK_BYTES", 100)
    parts = list(quality.features(texts, n))
    assert len(parts) > len(whole)
    assert np.array_equal(np.concatenate([p[0] for p in whole]), np.concatenate([p[0] for p in parts]))
    assert np.array_equal(np.concatenate([p[1] for p in whole]), np.concatenate([p[1] for p in parts]))


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    odd = [(9001, None, None, None, None, 1.0), (9002, "", "en", "s", 0, 1.0), (9003, "word " * 40_000, "en", "s", None, 1.0), (None, "some words", "en", "s", 3, 1.0), (1, rows[1][1], "en", "s", rows[1][4], 2.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long, score double")
    marked = spark.createDataFrame(labels + [(1, None, 1), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    machine = quality.train(docs, marked.where(~quality.held_out()))
    got = quality.score(docs, machine, "doc_id").withColumn("out", quality.held_out()).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in got if r.out and r.doc_id in truth]
    assert len(held) > 60 and sum(held) / len(held) > 0.95
    again = quality.train(docs.repartition(5), marked.where(~quality.held_out()))
    assert np.array_equal(machine.linear, again.linear) and np.array_equal(machine.factors, again.factors)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.col("doc_id") + 1})
    assert sorted(r.score for r in quality.score(other, machine, "doc_id").collect()) == sorted(r.score for r in got)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, none, "doc_id").collect()] == [0.5]
    one = quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality.score(docs, one, "doc_id").first().score > 0.99
    assert quality.score(docs.limit(0), one, "doc_id").count() == 0


def test_documents_that_share_a_doc_id_are_learnt_from_once(spark, monkeypatch):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, labels, **k: seen.append(len(rows)) or fit(rows, labels, **k))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "another"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, quality int")
    quality.train(docs, labels)
    quality.train(docs, labels, max_rows=1)
    assert seen == [3, 1]
