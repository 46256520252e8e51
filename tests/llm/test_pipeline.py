"""Every stage against brute force on what the stage before it kept."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as brute_components
from test_line_dedup import brute as brute_lines
from tokenizers import Tokenizer as Library

import corpus_pipeline as P
from paperloom.llm import decontaminate as D
from paperloom.llm import quality
from paperloom.llm._shared import stored


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """doc_id -> row after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        out.append(docs)
    return [sorted(d.collect(), key=lambda r: r.doc_id) for d in out], [d.columns for d in out]


def test_columns_and_names(kept):
    columns = kept[1]
    assert all(c == columns[0] for c in columns[:5]) and len(P.STAGES) == 5
    assert len({n for n, _ in P.STAGES}) == 5


def test_quality(kept, sf_dir):
    before, after = kept[0][0], {r.doc_id: r for r in kept[0][1]}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    right = [(r.doc_id in after) == bool(labels[r.doc_id]) for r in before if r.doc_id in labels]
    assert sum(right) / len(right) > 0.95
    assert all(after[r.doc_id] == r for r in before if r.doc_id in after)


def test_lines(kept):
    before, after = kept[0][1], kept[0][2]
    lost = {}
    for i, n, stays, *_ in brute_lines([(r.doc_id, r.text) for r in before]):
        if not stays:
            lost.setdefault(i, set()).add(n)
    want = {}
    for r in before:
        text = "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in lost.get(r.doc_id, ()))
        if r.doc_id not in lost or text.strip(" \t\r\n"):
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(kept):
    before, after = kept[0][2], kept[0][3]
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before]) if c == i}
    assert {r.doc_id for r in after} == want


def test_decontamination(kept, sf_dir):
    before, after = kept[0][3], kept[0][4]
    items = [D.normalise(t) for (t,) in duckdb.sql(f"select text from '{sf_dir}/benchmark.parquet'").fetchall()]
    clean = {r.doc_id for r in before if not any(D.best_stretch(x, D.normalise(r.text), D.budget(len(x), 0.05)) for x in items)}
    assert {r.doc_id for r in after} == clean


def test_encoding(kept):
    library = Library.from_file(P.public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in kept[0][5]}
    assert set(rows) == {r.doc_id for r in kept[0][4]}
    for r in kept[0][4]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (list(rows[r.doc_id].token_ids), rows[r.doc_id].n_tokens, rows[r.doc_id].round_trip) == (ids, len(ids), True)


def test_nulls_repeats_and_empty_table(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text = "A plain sentence of some words that stands here. Another one follows it with more words."
    rows = [(1, text, "en", "s", None), (2, text, None, None, 5), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, text + " Null id.", "en", "s", 9)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.count() <= len(data)
    assert docs.where(F.col("n_tokens") < 0).count() == 0 and quality.FEATURES > 0


def test_one_row_of_each_group_stays_whatever_the_ids(spark, sf_dir, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(None, words, 1), (5, words, 2), (5, words, 3), (3, words + " more", 4), (5, "another text under the same id as those", 5), (None, None, 6), (None, None, 7), (8, "", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, place int").coalesce(1).write.parquet(f"{tmp_path}/t")
    out = P.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/t"), sf_dir)
    assert sorted(r.place for r in out.collect()) == [4, 5, 6, 7, 8] and out.columns == ["doc_id", "text", "place"]
