"""Plan shape, invariants, files, models and streaming."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import classify as C
from paperloom.plans import process
from paperloom.plans.queries import QUERIES
from paperloom.sources import intake, sinks
from paperloom.sources.corpus import corpus_table, samples_raw
from paperloom.streaming.classify_stream import read_document_stream, start_classification


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = ["normalize_text", "segment_lines", "line_types", "line_fields", "classify", "layer_scores", "detect_tables",
          "suggest_fields", "rule_samples", "totals_scan", "explode_cells", "parse_samples", "valid_samples", "doc_metrics",
          "merge_fields", "totals_fields", "table_cell_fields", "element_counts", "rebuild_tables", "sparse_tables"]


@pytest.mark.parametrize("name", NARROW)
def test_document_local_work_does_not_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text
    assert "Join" not in text and text.count("FileScan") == 1


@pytest.mark.parametrize("name", ["document_report", "export_json", "merge_fields", "eval_metrics", "hybrid_nb", "tfidf_weights"])
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "Cartesian" not in text and "BroadcastNestedLoop" not in text


def test_scan_reads_only_needed_columns(spark, sf_dir):
    assert re.search(r"ReadSchema: struct<mime:string>|ReadSchema: struct<doc_id:bigint,mime:string>", plan(QUERIES["intake_route"](spark, sf_dir)))


def test_invariants(spark, sf_dir):
    docs, raw = corpus_table(spark, sf_dir, "text", "mime"), samples_raw(spark, sf_dir)
    r = process.process_documents(docs, raw)
    assert r.count() == docs.count() == r.select("doc_id").distinct().count()
    bad = r.filter(~F.col("overall_confidence").between(0, 1) | ~F.col("pass_rate").between(0, 1))
    assert bad.count() == 0


def test_hot_document_gives_the_same_result(spark):
    """Thousands of repeated fields in one document collapse to one vote."""
    from paperloom.operators import samples as S
    many = spark.range(20000).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("sample_no"), F.lit(0).alias("pos"),
        F.lit(" Total ").alias("name"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("value"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("struct<page:int,bbox:array<double>>").alias("source"))
    r = S.field_consensus(many).collect()
    assert len(r) == 1 and r[0].value == "b" and r[0].n_entries == 20000


def test_rules_from_table_equal_compiled_rules(spark):
    docs = spark.createDataFrame([(0, "A taxi invoice total amount 5 mg"), (1, ""), (2, "html terms")], "doc_id long, text string")
    table = C.keyword_scores_by_rules(docs, rules.keyword_rules_df(spark)).collect()
    compiled = C.layer_scores(docs).collect()
    want = {(r.doc_id, t): r[f"kw_{t}"] for r in compiled for t in rules.RULE_TYPES if r[f"kw_{t}"] > 0}
    assert {(r.doc_id, r.doc_type): pytest.approx(r.score) for r in table} == want


def test_files_and_sink(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.png").write_bytes(b"y")
    (tmp_path / "c.xyz").write_bytes(b"z")
    files = intake.route(intake.read_files(spark, str(tmp_path)))
    assert sorted(r.route for r in files.select("route").collect()) == ["image", "pdf", "unsupported"]
    records = spark.createDataFrame([(1, "bill", '{"doc_type":"bill"}')], "doc_id long, doc_type string, record string")
    sinks.write_records(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().doc_type == "bill"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["RECEIPT\nTotal: $5.00", "", "court motion"])], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_document_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    start_classification(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    a = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    b = C.classify(docs).drop("text").orderBy("doc_id").collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b]
