"""What is built, shuffled and read grows with the input and no faster."""

import os
import re

from pyspark.sql import functions as F

from paperloom.functions.text import WS, strip
from paperloom.operators import classify as C
from paperloom.operators import layout
from paperloom.plans.queries import QUERIES
from paperloom.sources.corpus import corpus, corpus_path, corpus_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_asked_columns_are_rendered_and_stored(spark, sf_dir, tmp_path):
    source = str(tmp_path / "tables")
    os.symlink(sf_dir, source)  # a source that no other test has stored
    path = corpus_path(spark, source, "mime", "text")
    assert set(spark.read.parquet(path).columns) == {"doc_id", "mime", "text"}
    assert corpus_path(spark, source, "text") == path != corpus_path(spark, source, "label")
    stored, made = corpus_table(spark, source, "text", "mime"), corpus(spark, source, "text", "mime")
    assert stored.count() == made.count() and stored.exceptAll(made).isEmpty()


def test_strip_looks_at_the_ends_only(spark):
    """The same as the pattern that it stands for, for every character; no pattern runs over the text."""
    chars = spark.range(1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    text = chars.select("c", F.concat("c", F.lit("\n a\n"), "c", F.lit("b \n"), "c").alias("t"))
    out = text.select("c", strip(F.col("t")).alias("new"), F.regexp_replace("t", f"^[{WS}]+|[{WS}]+$", "").alias("old"))
    assert out.filter(~F.col("new").eqNullSafe(F.col("old"))).count() == 0
    assert out.filter(F.col("new").startswith("a") & (F.col("c") != "a")).count() == 29
    assert "regexp" not in plan(text.select(strip(F.col("t"))))


def test_empty_cells_of_a_grid_are_not_shuffled(spark):
    rows = [(1, "a\n\nb", 100, 45), (1, "x", 100, 45), (1, "y", 60, 45), (None, "q\nr", 50, 50), (2, "", 30, 30), (3, None, 400, 400), (4, "z", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, image_width int, image_height int")
    out = layout.confidence_grid(layout.segment_lines(docs), docs)
    text = plan(out)
    assert text.index("Generate") < text.index("Exchange")
    got = {(r.doc_id, r.y_idx, r.x_idx): [] for r in out.collect()}
    for r in out.collect():
        got[r.doc_id, r.y_idx, r.x_idx].append((r.mean_confidence, r.n_lines))
    assert sorted(got[1, 0, 0]) == [(0.95, 1), (0.95, 2)] and got[1, 1, 0] == [(0.0, 0), (0.95, 1)] or got[1, 1, 0] == [(0.95, 1), (0.0, 0)]
    assert len([k for k in got if k[0] == 3]) == 400 and got[3, 19, 19] == [(0.0, 0)]
    assert got[4, 0, 0] == [(0.95, 1)] and got[None, 1, 0] == [(0.95, 1)] and got[2, 0, 0] == [(0.0, 0)]


def test_a_table_of_part_files_is_streamed_whole(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = QUERIES["classify_stream"](spark, str(tmp_path)), QUERIES["classify_documents"](spark, sf_dir)
    assert got.count() == docs.count() and got.exceptAll(want).isEmpty()
    assert QUERIES["classify_stream"](spark, sf_dir).count() == docs.count()


def test_grams_of_documents_stay_where_they_are_made(spark):
    """The few grams of a rule table go to the documents; only those that occur there are shuffled, once for both uses."""
    docs = spark.createDataFrame([(0, "a taxi invoice"), (0, "tax"), (1, "in"), (None, "tax"), (2, None), (3, "the tax, mg")], "doc_id long, text string").repartition(3)
    hits = C.keyword_hits(docs, spark.createDataFrame([("tax",), ("invoice",), ("mg",), ("none",), ("x",)], "keyword string"))
    text = plan(hits)
    assert "LeftSemi, BuildRight" in text and not re.search(r"SortMergeJoin \[gram#\d+\], \[gram#\d+\], (Inner|LeftSemi)", text)
    assert sorted(tuple(r) for r in hits.filter("doc_id > 0").collect()) == [(3, "mg"), (3, "tax"), (3, "x")]
    assert {r.keyword for r in hits.filter("doc_id = 0").collect()} == {"tax", "invoice", "x"}
