"""Term statistics, members of the fallback ensemble, hybrid choice, versions."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import ml_preprocess
from paperloom.operators import classify as C
from paperloom.operators import kernel as K
from paperloom.operators import ml, terms
from paperloom.plans.queries import QUERIES
from paperloom.sources.corpus import corpus_table
from paperloom.streaming import classify_stream
from paperloom.streaming.model_stream import start_retraining

LABELS = list(range(7))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def model(spark):
    return ml.FallbackModel.fit(rules.cold_start_df(spark), LABELS)


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


# ---- term statistics ---------------------------------------------------------------


def test_terms_are_counted_in_the_row(spark):
    data = [["b", "a", "b"], [], ["z"] * 5000 + ["a"], None, ["é", "", "é", ""]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "doc_id int, terms array<string>")
    got = sorted(tuple(r) for r in terms.term_counts(df, ["doc_id"]).collect())
    assert got == sorted((i, t, n) for i, d in enumerate(data) for t, n in Counter(d or []).items())


@pytest.mark.parametrize("name, most", [("tfidf_vocab", 4), ("tfidf_weights", 0), ("top_terms", 0), ("nb_predict", 0), ("hybrid_nb", 0), ("hybrid_classify", 0)])
def test_exchanges(spark, sf_dir, name, most):
    """Vocabulary and model meet documents inside the plan; only term statistics are exchanged, by term."""
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("Exchange") <= most and "Join" not in text and "Window" not in text


def test_fitting_exchanges_by_term_only(spark, sf_dir):
    corpus_table(spark, sf_dir, "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = plan(terms.tfidf_vocab(docs))
    assert "doc_id" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_stop_words_are_a_parameter(spark):
    docs = texts(spark, "alpha beta", "alpha beta gamma")
    words = {r.term for r in terms.tfidf_vocab(docs, max_df=1.0, stop_words=["beta"]).collect()}
    assert words == {"alpha"}


# ---- members ------------------------------------------------------------------------


def exact_kernel(x, y, gamma, n_labels, others):
    """Least-squares machines with the exact RBF kernel, and Platt's sigmoids."""
    def gram(a, b):
        return np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    n = len(x)
    side = np.where(y[:, None] == np.arange(n_labels), 1.0, -1.0)
    system = np.block([[gram(x, x) + K.RIDGE * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.concatenate([side, np.zeros((1, n_labels))]))
    margins = gram(x, x) @ solved[:-1] + solved[-1]
    platt = np.array([K.fit_platt(margins[:, k], (side[:, k] > 0).astype(float), (side[:, k] < 0).astype(float)) for k in range(n_labels)])
    return K.probabilities(gram(others, x) @ solved[:-1] + solved[-1], platt)


def test_kernel_member_is_near_an_exact_rbf_machine(spark):
    """Within 0.1 on the cold-start rows and on other texts, with 1,024 features; same labels."""
    train = rules.cold_start_df(spark)
    model = ml.FallbackModel.fit(train.coalesce(2), LABELS)
    space, n = model.bayes.space, len(model.bayes.space.terms)
    other = texts(spark, "invoice total amount due", "the court and the plaintiff", "patient diagnosis and dosage", "nothing of the kind", "receipt cashier change total")

    def dense(df, text):
        rows = space.weighted(terms.with_terms(df, text, ["doc_id"]), ["doc_id"]).orderBy("doc_id").collect()
        out = np.zeros((len(rows), n))
        for i, r in enumerate(rows):
            out[i, r.idx] = r.weight
        return out
    x, y = dense(train, F.col("text")), np.array([r.label for r in train.orderBy("doc_id").collect()])
    gamma = 1 / (n * x.var())
    assert model.kernel.gamma == pytest.approx(gamma, rel=1e-9)
    for df, text in ((train, F.col("text")), (other, ml_preprocess(F.col("text")))):
        want = exact_kernel(x, y, gamma, 7, dense(df, text))
        rows = model.probabilities(terms.with_terms(df, text, ["doc_id"]), ["doc_id"], "kernel").orderBy("doc_id").collect()
        got = np.array([r.probs for r in rows])
        print('gap', np.abs(got - want).max())
        assert np.abs(got - want).max() < 0.1 and (got.argmax(axis=1) == want.argmax(axis=1)).all()
        assert got.sum(axis=1) == pytest.approx(np.ones(len(got)))


def test_ensemble_mixes_its_members(spark, model):
    docs = texts(spark, "The patient visit: prescription and dosage", "court filing motion", "", "total total tax", None)
    by = {w: {r.doc_id: r for r in model.predict(docs, w).collect()} for w in ("kernel", "nb", "ensemble")}
    a, b = rules.ENSEMBLE_WEIGHTS
    for i, r in by["ensemble"].items():
        mixed = [a * x + b * y for x, y in zip(by["kernel"][i].probs, by["nb"][i].probs)]
        assert r.probs == pytest.approx(mixed) and r.label == int(np.argmax(mixed)) and sum(r.probs) == pytest.approx(1)


def test_projection_of_many_terms_equals_the_plain_product():
    rng = np.random.default_rng(1)
    sizes = [0, 3, 0, 9000, 1, 0]
    idx = np.concatenate([rng.choice(9500, s, replace=False) for s in sizes]).astype(int)
    weight, starts = rng.random(len(idx)), np.concatenate([[0], np.cumsum(sizes)])
    got = K.project(idx, weight, starts, 9500, 16, 0.3, 5)
    directions, phase = K._projection(9500, 16, 0.3, 5)
    for i in range(len(sizes)):
        own = slice(starts[i], starts[i + 1])
        want = np.sqrt(2 / 16) * np.cos((directions[idx[own]] * weight[own, None]).sum(axis=0) + phase)
        assert got[i, :-1] == pytest.approx(want) and got[i, -1] == 1


# ---- hybrid ------------------------------------------------------------------------


def test_model_results_explain_themselves(spark, model):
    docs = C.with_indicators(C.classify(texts(spark, "RECEIPT\nTotal: $5.00\nThank you", "patient diagnosis dosage clinic visit", "")))
    rows = {r.doc_id: r for r in model.hybrid(docs, threshold=1.1).collect()}
    rule = {r.doc_id: r for r in docs.collect()}
    decided = Counter(r.decided_by for r in rows.values())
    assert decided["model"] and decided["rules"]
    for i, r in rows.items():
        assert r.context_matches == rule[i].context_matches
        if r.decided_by == "rules":
            assert (r.primary_indicators, r.secondary_indicators, r.keyword_score) == (rule[i].primary_indicators, rule[i].secondary_indicators, rule[i].keyword_score)
        else:
            assert r.primary_indicators[-2:] == rule[i].primary_indicators[:2] or not rule[i].primary_indicators
            assert len(r.secondary_indicators) <= 3 and (r.keyword_score, r.structural_score, r.context_score) == (r.confidence, 0.0, 0.0)
            own = [t for t in r.primary_indicators if t in model.bayes.space.terms][:3] + r.secondary_indicators
            assert all(t in model.bayes.space.terms for t in r.secondary_indicators) and len(set(own)) == len(own)
    never = model.hybrid(docs, threshold=0.0).collect()
    assert all(r.decided_by == "rules" for r in never)


def test_hybrid_on_the_corpus_agrees_with_its_parts(spark, sf_dir):
    rows = QUERIES["hybrid_classify"](spark, sf_dir).collect()
    rule = {r.doc_id: r for r in QUERIES["classify"](spark, sf_dir).collect()}
    member = {r.doc_id: r for r in QUERIES["ensemble_predict"](spark, sf_dir).collect()}
    assert len(rows) == len(rule)
    for r in rows:
        sure = rule[r.doc_id].confidence
        use = sure < rules.ML_THRESHOLD and member[r.doc_id].confidence > round(sure, 6)
        assert (r.decided_by == "model") == use
        assert r.doc_type == (member[r.doc_id].doc_type if use else rule[r.doc_id].doc_type)


# ---- untrained, failing, saved -------------------------------------------------------


@pytest.mark.parametrize("rows", [[], [(1, "only one text here", 0)], [(1, "same words", 99), (2, "same words", 99)], [(1, None, 0), (2, "", 1)], [(1, "two words", None), (2, "two words", None)]])
def test_without_anything_to_learn_the_model_says_unknown(spark, rows, tmp_path):
    """No rows, no term often enough, only labels that aren't asked for, no text."""
    model = ml.FallbackModel.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), LABELS)
    assert not model.is_trained and not model.info()["is_trained"]
    model.save(spark, str(tmp_path / "m"))
    for m in (model, ml.FallbackModel.load(spark, str(tmp_path / "m"))):
        out = m.predict(texts(spark, "a text", None)).select("label", "confidence", ml.label_name(F.col("label")).alias("t")).collect()
        assert [tuple(r) for r in out] == [(None, 0.0, "unknown")] * 2
    kept = model.hybrid(C.with_indicators(C.classify(texts(spark, "some text")))).collect()
    assert kept[0].decided_by == "rules"


def test_labels_that_are_not_asked_for_are_left_out(spark):
    train = rules.cold_start_df(spark)
    more = train.union(train.withColumn("label", F.lit(42)))
    a, b = ml.FallbackModel.fit(train, LABELS), ml.FallbackModel.fit(more, LABELS)
    assert a.bayes.priors == b.bayes.priors and a.kernel.weights == pytest.approx(b.kernel.weights)


def test_model_survives_saving(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    loaded = ml.FallbackModel.load(spark, str(tmp_path / "m"))
    docs = texts(spark, "RECEIPT\nTotal: $5.00\nThank you", "plaintiff and attorney", "")
    a, b = (m.predict(docs).orderBy("doc_id").collect() for m in (model, loaded))
    assert a == b and loaded.info() == model.info()
    assert model.info()["supported_types"] == rules.DOC_TYPES[:7] and model.info()["n_terms"] == len(model.bayes.space.terms)


def test_failing_refit_leaves_the_model(spark, model, monkeypatch):
    rows = rules.cold_start_df(spark)
    assert ml.retrain(model, rows.limit(0), LABELS) is model and ml.retrain(None, rows.limit(0), LABELS) is None
    monkeypatch.setattr(K, "fit", lambda *a, **k: 1 / 0)
    assert ml.retrain(model, rows, LABELS) is model and "ZeroDivisionError" in model.last_failure


def test_versions_from_a_stream(spark, tmp_path):
    """Every batch with something to learn is a version; empty and failing ones leave the one in use; a restart goes on."""
    schema, source, root, checkpoint = "doc_id long, text string, label int", str(tmp_path / "in"), str(tmp_path / "models"), str(tmp_path / "cp")
    assert ml.current_version(spark, root) is None and not ml.current_model(spark, root, LABELS).is_trained
    cold = rules.cold_start_df(spark)

    def feed(df, failed=None):
        df.coalesce(1).write.mode("append").parquet(source)
        stream = classify_stream.read_document_stream(spark, source, schema, glob="*.parquet")
        start_retraining(stream, root, checkpoint, LABELS, failed).awaitTermination()
        return ml.current_version(spark, root)

    first = feed(cold)
    assert first == "v00000000" and ml.current_model(spark, root, LABELS).is_trained
    assert feed(cold.withColumn("label", F.lit(77))) == first
    problems = []
    fit, ml.FallbackModel.fit = ml.FallbackModel.fit, lambda rows, labels: 1 / 0
    try:
        assert feed(cold, lambda n, e: problems.append((n, type(e)))) == first
    finally:
        ml.FallbackModel.fit = fit
    assert problems == [(2, ZeroDivisionError)]
    last = feed(cold.filter("label < 3"))
    assert last == "v00000003"
    priors = ml.current_model(spark, root, LABELS).bayes.priors
    assert priors[:3] == pytest.approx([np.log(1 / 3)] * 3) and priors[3] == -np.inf
    ml.publish(spark, ml.FallbackModel.load(spark, f"{root}/{first}"), root, first)
    assert ml.current_version(spark, root) == first
