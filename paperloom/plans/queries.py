"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query runs over whole tables.  Doubles are rounded and arrays joined to
text at the edge only, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import scores
from paperloom.functions.text import confidence_band, ml_preprocess, normalize_name, normalize_text
from paperloom.operators import classify as C
from paperloom.operators import evaluate, layout, locate, merge, ml, report, suggest, tables, terms, totals, validate
from paperloom.operators import samples as S
from paperloom.plans import process
from paperloom.session import work_dir
from paperloom.sources import intake
from paperloom.sources.corpus import corpus_table as corpus
from paperloom.sources.corpus import corpus_path, samples_raw, truth
from paperloom.sources.tables import read_table
from paperloom.streaming import batch_stream, classify_stream

COLD_LABELS = list(range(7))
QUALITY_LABELS = [0, 1]


def _r(c: str | Column, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _joined(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def _documents(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "documents").select("doc_id", *cols)


# ---- intake ----------------------------------------------------------------------


def intake_route(spark, sf_dir):
    return intake.route(corpus(spark, sf_dir, "mime")).select("doc_id", "mime", "route", "method")


def intake_size_gate(spark, sf_dir):
    return intake.size_gate(corpus(spark, sf_dir, "size_bytes")).select(
        "doc_id", "size_bytes", _r("size_mb").alias("size_mb"), "base64_chars", "est_tokens", "gate")


def _candidates(spark, sf_dir):
    """Which path yields text follows from route, gate and what the corpus says of the file's pages."""
    files = intake.size_gate(intake.route(corpus(spark, sf_dir, "mime", "size_bytes", "readable", "rasterised", "text")))
    pdf, image, ok = F.col("route") == "pdf", F.col("route") == "image", F.col("readable")
    return files.select(
        "doc_id", F.when(ok & pdf & (F.col("gate") == "direct"), F.col("text")).alias("direct_text"),
        F.when(ok & (image | (pdf & F.col("rasterised"))), F.col("text")).alias("images_text"),
        F.when(ok & pdf, F.col("text")).alias("basic_text"),
        F.size(layout.lines_array(F.col("text"))).alias("n_lines"),
        F.size(tables.tables_array(F.col("text"))).alias("n_tables"))


def intake_method(spark, sf_dir):
    return intake.choose_method(_candidates(spark, sf_dir)).select(
        "doc_id", "method", F.length("text").alias("n_chars"), _r("quality").alias("quality"))


def assemble_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return intake.assemble_pages(pages)


SENT = ("sent_mime", "sent_size", "received", "text")


def _batch(spark, sf_dir):
    return _sent(corpus(spark, sf_dir, *SENT))


def _sent(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.col("sent_mime").alias("mime"), F.col("sent_size").alias("size_bytes"), F.when(F.col("received"), F.col("text")).alias("text"))


def batch_isolation(spark, sf_dir):
    """All files as a stream: classified ones beside those set apart, with the reason."""
    out, path = f"{work_dir(spark)}/batches-{uuid.uuid4().hex}", corpus_path(spark, sf_dir, *SENT)
    files = _sent(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    batch_stream.start_batches(files, lambda good: C.classify(good).select("doc_id", "doc_type"), f"{out}/results", f"{out}/quarantine", f"{out}/checkpoint").awaitTermination()
    good = spark.read.schema("doc_id long, doc_type string, batch int").parquet(f"{out}/results").select("doc_id", F.lit("results").alias("sink"), "doc_type", F.lit(None).cast("string").alias("error"))
    bad = spark.read.schema("doc_id long, error string, batch int").parquet(f"{out}/quarantine").select("doc_id", F.lit("quarantine").alias("sink"), F.lit(None).cast("string").alias("doc_type"), "error")
    return good.union(bad)


def batch_status(spark, sf_dir):
    return intake.batch_status(_batch(spark, sf_dir)).select("doc_id", "status", "error")


def template_catalog(spark, sf_dir):
    docs = corpus(spark, sf_dir, "stated_type").withColumnRenamed("stated_type", "doc_type")
    return suggest.template_catalog(docs, rules.templates_df(spark)).select("doc_id", "doc_type", "pos", "field")


# ---- text ------------------------------------------------------------------------


def normalize_text_q(spark, sf_dir):
    return _documents(spark, sf_dir, "text").select("doc_id", normalize_text(F.col("text")).alias("norm"))


def ml_preprocess_q(spark, sf_dir):
    return _documents(spark, sf_dir, "text").select("doc_id", ml_preprocess(F.col("text")).alias("processed"))


def normalize_name_q(spark, sf_dir):
    fields = S.sample_fields(S.valid_samples(S.parse_samples(samples_raw(spark, sf_dir))))
    return fields.groupBy("name", normalize_name(F.col("name")).alias("norm_name")).agg(F.count(F.lit(1)).alias("n"))


def segment_lines(spark, sf_dir):
    lines = layout.segment_lines(_documents(spark, sf_dir, "text"))
    return lines.select("doc_id", "line_idx", "text", "x", "y", "w", "h", "confidence", "element_type")


def line_types(spark, sf_dir):
    lines = layout.segment_lines(corpus(spark, sf_dir, "mime", "text"))
    return lines.select("doc_id", "line_idx", "text", "w", "confidence", "element_type")


def element_counts(spark, sf_dir):
    return layout.count_elements(corpus(spark, sf_dir, "text"))


def layout_points(spark, sf_dir):
    return layout.layout_points(layout.segment_lines(corpus(spark, sf_dir, "mime", "text")))


def confidence_grid(spark, sf_dir):
    lines = layout.segment_lines(corpus(spark, sf_dir, "mime", "text", "image_width", "image_height"))
    return layout.confidence_grid(lines).withColumn("mean_confidence", _r("mean_confidence"))


def confidence_grid_dense(spark, sf_dir):
    docs = corpus(spark, sf_dir, "mime", "text", "image_width", "image_height")
    return layout.confidence_grid(layout.segment_lines(docs), docs).withColumn("mean_confidence", _r("mean_confidence"))


def line_fields(spark, sf_dir):
    return layout.line_fields(corpus(spark, sf_dir, "text"))


# ---- classification --------------------------------------------------------------


def _layer(prefix: str, spark, sf_dir, keep_zero_types) -> DataFrame:
    df = C.layer_scores(corpus(spark, sf_dir, "text"))
    pairs = F.array(*[F.struct(F.lit(t).alias("doc_type"), F.col(f"{prefix}_{t}").alias("score"))
                      for t in rules.RULE_TYPES if t in keep_zero_types])
    return df.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.doc_type", _r("p.score").alias("score"))


def keyword_scores(spark, sf_dir):
    return _layer("kw", spark, sf_dir, rules.RULE_TYPES).filter(F.col("score") > 0)


def structural_scores(spark, sf_dir):
    return _layer("st", spark, sf_dir, [r[0] for r in rules.STRUCTURE_RULES])


def context_scores(spark, sf_dir):
    return _layer("cx", spark, sf_dir, [r[0] for r in rules.CONTEXT_RULES])


def keyword_scores_rules(spark, sf_dir):
    return C.keyword_scores_by_rules(corpus(spark, sf_dir, "text"), rules.keyword_rules_df(spark)).withColumn(
        "score", _r("score"))


def layer_scores(spark, sf_dir):
    df = C.with_candidates(corpus(spark, sf_dir, "text"))
    return df.select("doc_id", F.explode(F.array_compact("candidates")).alias("c")).select(
        "doc_id", "c.doc_type", _r("c.score").alias("score"))


def _classified_cols(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "doc_type", _r("confidence").alias("confidence"),
                     _r("keyword_score").alias("keyword_score"), _r("structural_score").alias("structural_score"),
                     _r("context_score").alias("context_score"), "confidence_level")


def classify(spark, sf_dir):
    return _classified_cols(C.classify(corpus(spark, sf_dir, "text")))


def classify_documents(spark, sf_dir):
    return _classified_cols(C.classify(_documents(spark, sf_dir, "text")))


def indicators(spark, sf_dir):
    df = C.with_indicators(C.classify(corpus(spark, sf_dir, "text")))
    return df.select("doc_id", "doc_type", _joined("primary_indicators").alias("primary_indicators"),
                     _joined("secondary_indicators").alias("secondary_indicators"),
                     _joined("context_matches").alias("context_matches"))


def confidence_band_q(spark, sf_dir):
    df = C.classify(corpus(spark, sf_dir, "text"))
    return df.groupBy(confidence_band(F.col("confidence")).alias("band")).agg(
        F.count(F.lit(1)).alias("n_docs"), _r(F.min("confidence")).alias("lowest"), _r(F.max("confidence")).alias("highest"))


def corpus_report(spark, sf_dir):
    classed = C.classify(corpus(spark, sf_dir, "text"))
    return report.corpus_report(classed, S.qa_merge(_valid(spark, sf_dir))).withColumn("mean_confidence", _r("mean_confidence"))


# ---- suggestions and extraction ---------------------------------------------------


def _suggested(spark, sf_dir, *cols):
    return suggest.suggest_fields(C.classify(corpus(spark, sf_dir, "text", "user_fields", *cols)))


def suggest_fields(spark, sf_dir):
    return _suggested(spark, sf_dir).select(
        "doc_id", "doc_type", _joined("suggested").alias("suggested"), F.size("suggested").alias("n_suggested"))


def map_doc_type(spark, sf_dir):
    df = C.classify(corpus(spark, sf_dir, "text", "mime"))
    recognised = F.col("mime") != "text/csv"
    return df.select("doc_id", "doc_type", suggest.output_type(
        F.col("doc_type"), F.col("text"), recognised).alias("output_type"))


def render_prompt(spark, sf_dir):
    df = _suggested(spark, sf_dir).withColumn(
        "output_type", suggest.output_type(F.col("doc_type"), F.col("text"), F.lit(True)))
    return suggest.render_request(df)


def fallback_fields(spark, sf_dir):
    return suggest.fallback_fields(_suggested(spark, sf_dir))


def rule_samples(spark, sf_dir):
    return suggest.rule_samples(_suggested(spark, sf_dir))


# ---- totals ----------------------------------------------------------------------


def totals_scan(spark, sf_dir):
    return totals.scan_totals(corpus(spark, sf_dir, "text"))


def totals_fields(spark, sf_dir):
    return merge.merge_in_row(corpus(spark, sf_dir, "text"), totals=totals.totals_pairs(F.col("text"))).drop("source")


def amounts_report(spark, sf_dir):
    return totals.amounts_report(totals.scan_totals(corpus(spark, sf_dir, "text"))).withColumn(
        "status", _joined("status"))


def order_reconcile(spark, sf_dir):
    orders = corpus(spark, sf_dir, "price_kind").withColumnRenamed("doc_id", "l_orderkey")
    items = read_table(spark, sf_dir, "lineitem").join(
        read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("price_kind") == "net", F.col("l_extendedprice") / F.col("l_quantity"))
        .otherwise(F.col("p_retailprice")).alias("unit_price"), F.col("l_extendedprice").alias("total"))
    stated = truth(spark, sf_dir).withColumn("norm", normalize_name(F.col("name")))
    context = (F.when(F.col("norm") == "subtotal", "subtotal").when(F.col("norm").isin("tax", "tax amount"), "tax")
               .when(F.col("norm") == "total amount", "total"))
    amounts = stated.select("doc_id", F.col("pos").alias("ord"), context.alias("context"),
                            F.col("value").try_cast("double").alias("value")).filter("context IS NOT NULL")
    out = totals.reconcile(items, amounts)
    return out.select("doc_id", "n_items", "n_bad_items", _r("items_total", 2).alias("items_total"),
                      "subtotal", "tax", "total", "subtotal_matches", "tax_calculation_valid", "total_matches",
                      _joined("discrepancies").alias("discrepancies"), _joined("status").alias("status"))


# ---- tables ----------------------------------------------------------------------


def detect_tables(spark, sf_dir):
    t = tables.detect_tables(corpus(spark, sf_dir, "text"))
    return t.select("doc_id", "table_idx", "rows", "cols", "x", "y", "w", "h", "table_type", "has_header",
                    _joined(F.transform("grid", lambda r: F.array_join(r, "|")), "/").alias("content"))


def _response_tables(spark, sf_dir):
    return tables.parse_tables(corpus(spark, sf_dir, "tables_json").withColumnRenamed("tables_json", "json"))


def explode_cells(spark, sf_dir):
    return tables.explode_cells(_response_tables(spark, sf_dir)).drop("cell_ord")


def rebuild_tables(spark, sf_dir):
    """Every row of every table; in those beyond the dense size empty rows and the empty ends of rows are numbers."""
    out = tables.table_rows(tables.sparse_tables(_response_tables(spark, sf_dir)))
    return out.select("doc_id", "table_idx", "kind", "row_no", _joined("values").alias("row_values"), "n_rows", "n_cols")


def sparse_tables(spark, sf_dir):
    """Every table, however large it says it is: its size as numbers, and one row for each grid row that holds a cell."""
    out = tables.sparse_rows(tables.sparse_tables(_response_tables(spark, sf_dir)))
    cells = F.transform("cells", lambda c: F.concat(c["col"].cast("string"), F.lit("="), c["content"]))
    return out.select("doc_id", "table_idx", "rows", "cols", "headed", "kind", "row_no", _joined(cells).alias("cells"))


def table_rects(spark, sf_dir):
    return tables.table_rects(_response_tables(spark, sf_dir))


def table_cell_fields(spark, sf_dir):
    rows = tables.answered(corpus(spark, sf_dir, "tables_json").withColumnRenamed("tables_json", "json"), "doc_id")
    return merge.merge_in_row(rows, table=tables.cell_pairs("tables")).drop("source")


def extract_quality(spark, sf_dir):
    counted = corpus(spark, sf_dir, "text").select(
        "doc_id", "text", F.size(layout.lines_array(F.col("text"))).alias("n_lines"),
        F.size(tables.tables_array(F.col("text"))).alias("n_tables"))
    return counted.select(
        "doc_id", _r(scores.quality_image(F.col("text"), F.col("n_lines"), F.col("n_tables"))).alias("image_quality"),
        _r(scores.quality_direct(F.col("text"), F.col("n_tables"))).alias("pdf_quality"))


def doc_metrics(spark, sf_dir):
    return report.doc_metrics(corpus(spark, sf_dir, "mime", "text")).withColumn("quality", _r("quality"))


# ---- samples ---------------------------------------------------------------------


def _parsed(spark, sf_dir):
    return S.parse_samples(samples_raw(spark, sf_dir))


def _valid(spark, sf_dir):
    return S.valid_samples(_parsed(spark, sf_dir))


def _consensus(spark, sf_dir):
    return S.field_consensus(S.sample_fields(_valid(spark, sf_dir)))


def parse_samples(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "doc_id", "sample_no", "status", "doc_type", F.size("fields").alias("n_fields"), "overall_confidence")


def valid_samples(spark, sf_dir):
    return _valid(spark, sf_dir).select(
        "doc_id", "sample_no", "valid", "doc_type", F.when(F.col("valid"), F.size("fields")).alias("n_fields"),
        _r("overall_confidence").alias("overall_confidence"), _joined("passed_rules").alias("passed_rules"),
        _joined("failed_rules").alias("failed_rules"))


def vote_doc_type(spark, sf_dir):
    return S.vote_doc_type(_valid(spark, sf_dir))


def sample_confidence(spark, sf_dir):
    return S.sample_confidence(_valid(spark, sf_dir)).withColumn("mean_confidence", _r("mean_confidence"))


def qa_merge(spark, sf_dir):
    return S.qa_merge(_valid(spark, sf_dir))


def field_consensus(spark, sf_dir):
    c = _consensus(spark, sf_dir)
    return c.select("doc_id", "norm_name", "name", "value", _r("confidence").alias("confidence"), "n_entries",
                    F.col("source.page").alias("page"),
                    _joined(F.transform("source.bbox", lambda v: v.cast("int").cast("string"))).alias("bbox"))


# ---- validation ------------------------------------------------------------------


def validate_fields(spark, sf_dir):
    fields = S.sample_fields(_valid(spark, sf_dir))
    return validate.validate_fields(fields).select("doc_id", "sample_no", "pos", "norm_name", "value", "valid")


def totals_match(spark, sf_dir):
    return validate.totals_match(_consensus(spark, sf_dir))


def validation_summary(spark, sf_dir):
    fields = S.sample_fields(_valid(spark, sf_dir)).withColumn("ord", S._order("sample_no", "pos"))
    return validate.validation_summary(fields).withColumns({"pass_rate": _r("pass_rate"), "failed_rules": _joined("failed_rules")})


def source_locate(spark, sf_dir):
    found = locate.locate_sources(_consensus(spark, sf_dir), corpus(spark, sf_dir, "text"))
    return found.select("doc_id", "norm_name", "value", "line_idx", "page",
                        _joined(F.transform("bbox", lambda v: v.cast("int").cast("string"))).alias("bbox"),
                        "source_confidence")


# ---- scoring ---------------------------------------------------------------------


def _scored(spark, sf_dir):
    model = _bayes(rules.cold_start_df(spark), COLD_LABELS)
    return process.scored_fields(corpus(spark, sf_dir, "text", "mime"), samples_raw(spark, sf_dir), process.with_model(model))


def field_confidence(spark, sf_dir):
    return _scored(spark, sf_dir).filter("norm_name IS NOT NULL").select(
        "doc_id", "norm_name", "value", "valid", "line_idx", _r("confidence").alias("confidence"))


def process_file(spark, sf_dir):
    """The whole process, one row for each document."""
    df = process.document_results(_scored(spark, sf_dir))
    return df.select("doc_id", "doc_type", "n_votes", "class_type", "output_type", _r("classification_confidence", 6).alias("classification_confidence"),
                     "confidence_level", "decided_by", "n_samples", "n_names", "n_located", _r("pass_rate").alias("pass_rate"), "notes", "totals_match",
                     _r("overall_confidence", 6).alias("overall_confidence"))


def process_fields(spark, sf_dir):
    return process.extracted_fields(corpus(spark, sf_dir, "text", "mime", "tables_json"), samples_raw(spark, sf_dir))


def overall_confidence(spark, sf_dir):
    df = process.document_results(_scored(spark, sf_dir))
    return df.select("doc_id", "doc_type", "output_type", "n_samples", "n_names", "n_located",
                     _r("pass_rate").alias("pass_rate"), "notes", "totals_match",
                     _r("overall_confidence", 6).alias("overall_confidence"))


def document_report(spark, sf_dir):
    df = process.type_report(process.document_results(_scored(spark, sf_dir)))
    return df.withColumns({"mean_overall": _r("mean_overall", 6), "mean_pass_rate": _r("mean_pass_rate")})


def export_json(spark, sf_dir):
    fields = _scored(spark, sf_dir)
    return report.output_records(process.document_results(fields), fields.filter("norm_name IS NOT NULL")).select(
        "doc_id", "doc_type", "record")


def merge_fields(spark, sf_dir):
    docs = suggest.suggest_fields(C.classify(corpus(spark, sf_dir, "text", "user_fields", "tables_json")))
    made = docs.select("doc_id", suggest.fallback_pairs().alias("base"), totals.totals_pairs(F.col("text")).alias("totals"),
                       layout.typed_lines(F.col("text")).alias("lines"), F.col("tables_json").alias("json"))
    rows = tables.answered(made, "doc_id", "base", "totals", "lines")
    return merge.merge_in_row(rows, base=F.col("base"), table=tables.cell_pairs("tables"), totals=F.col("totals"), line=layout.line_pairs("lines"))


# ---- evaluation ------------------------------------------------------------------


def _outcomes(spark, sf_dir):
    return evaluate.eval_fields(_consensus(spark, sf_dir),
                                truth(spark, sf_dir).withColumnRenamed("pos", "ord"))


def eval_fields(spark, sf_dir):
    return _outcomes(spark, sf_dir)


def eval_metrics(spark, sf_dir):
    df = evaluate.eval_metrics(_outcomes(spark, sf_dir))
    return df.withColumns({c: _r(c) for c in ("precision", "recall", "f1")})


def eval_by_field(spark, sf_dir):
    df = evaluate.eval_by_field(_outcomes(spark, sf_dir))
    return df.withColumns({c: _r(c) for c in ("precision", "recall", "f1")})


# ---- models ----------------------------------------------------------------------


def _labelled(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return _documents(spark, sf_dir, "text").join(labels, "doc_id")


def tfidf_vocab(spark, sf_dir):
    return terms.tfidf_vocab(_documents(spark, sf_dir, "text")).withColumn("idf", _r("idf", 6))


def _space(spark, sf_dir):
    return terms.Space.of(terms.tfidf_vocab(_documents(spark, sf_dir, "text")))


def tfidf_weights(spark, sf_dir):
    return terms.tfidf_weights(_documents(spark, sf_dir, "text"), _space(spark, sf_dir)).withColumn("weight", _r("weight", 6))


def top_terms(spark, sf_dir):
    return terms.top_terms(_documents(spark, sf_dir, "text"), _space(spark, sf_dir)).withColumn("weight", _r("weight", 6))


def _bayes(train, labels):
    return ml.nb_model(train, terms.Space.of(terms.tfidf_vocab(train)), labels)


def nb_model(spark, sf_dir):
    model = _bayes(_labelled(spark, sf_dir), QUALITY_LABELS)
    return ml.nb_model_rows(spark, model).withColumn("log_prob", _r("log_prob", 6))


def nb_predict(spark, sf_dir):
    out = ml.nb_predict(_documents(spark, sf_dir, "text"), _bayes(_labelled(spark, sf_dir), QUALITY_LABELS))
    return out.select("doc_id", "label", _r("confidence", 6).alias("confidence"))


def _hybrid_cols(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "doc_type", _r("confidence", 6).alias("confidence"), "confidence_level", "decided_by",
                     *[_joined(c).alias(c) for c in ("primary_indicators", "secondary_indicators", "context_matches")],
                     *[_r(c, 6).alias(c) for c in ("keyword_score", "structural_score", "context_score")])


def _explained(spark, sf_dir):
    return C.with_indicators(C.classify(corpus(spark, sf_dir, "text")))


def hybrid_nb(spark, sf_dir):
    return _hybrid_cols(ml.hybrid_nb(_explained(spark, sf_dir), _bayes(rules.cold_start_df(spark), COLD_LABELS)))


def _cold_model(spark):
    return ml.FallbackModel.fit(rules.cold_start_df(spark), COLD_LABELS)


def lr_predict(spark, sf_dir):
    out = ml.linear_predict(rules.cold_start_df(spark), corpus(spark, sf_dir, "text"), COLD_LABELS)
    return out.select("doc_id", "label", _r("confidence", 6).alias("confidence"))


def kernel_predict(spark, sf_dir):
    return _cold_model(spark).predict(corpus(spark, sf_dir, "text"), "kernel").select(
        "doc_id", "label", ml.label_name(F.col("label")).alias("doc_type"), _r("confidence", 6).alias("confidence"))


def ensemble_predict(spark, sf_dir):
    return _cold_model(spark).predict(corpus(spark, sf_dir, "text")).select(
        "doc_id", "label", ml.label_name(F.col("label")).alias("doc_type"), _r("confidence", 6).alias("confidence"))


def hybrid_classify(spark, sf_dir):
    return _hybrid_cols(_cold_model(spark).hybrid(_explained(spark, sf_dir)))


def hybrid_untrained(spark, sf_dir):
    """The hybrid choice without a model: the fallback says unknown, 0.0, and never wins."""
    return _hybrid_cols(ml.FallbackModel(COLD_LABELS).hybrid(_explained(spark, sf_dir)))


def retrain(spark, sf_dir):
    """Refit on the labelled documents and score all documents with the new model."""
    model = ml.retrain(None, _labelled(spark, sf_dir), QUALITY_LABELS)
    return model.predict(_documents(spark, sf_dir, "text")).select(
        "doc_id", "label", _r("confidence", 6).alias("confidence"))


def model_roundtrip(spark, sf_dir):
    """Fit on the labelled documents, save, load, and score with the loaded model."""
    path = f"{work_dir(spark)}/model-{uuid.uuid4().hex}"
    ml.FallbackModel.fit(_labelled(spark, sf_dir), QUALITY_LABELS).save(spark, path)
    return ml.FallbackModel.load(spark, path).predict(_documents(spark, sf_dir, "text")).select(
        "doc_id", "label", _r("confidence", 6).alias("confidence"))


# ---- streaming -------------------------------------------------------------------


def classify_stream_q(spark, sf_dir):
    """All documents as a file stream, classified into a table."""
    out = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a pattern, as the table may be one file or a folder of part files; a stream takes only folders by their name
    stream = classify_stream.read_document_stream(spark, f"{sf_dir}/[d]ocuments.parquet")
    classify_stream.start_classification(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return _classified_cols(spark.read.parquet(f"{out}/table"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "intake_route": intake_route, "intake_size_gate": intake_size_gate, "intake_method": intake_method,
    "assemble_pages": assemble_pages, "batch_status": batch_status, "batch_isolation": batch_isolation, "template_catalog": template_catalog,
    "normalize_text": normalize_text_q, "ml_preprocess": ml_preprocess_q, "normalize_name": normalize_name_q,
    "segment_lines": segment_lines, "line_types": line_types, "element_counts": element_counts,
    "layout_points": layout_points, "confidence_grid": confidence_grid,
    "confidence_grid_dense": confidence_grid_dense, "line_fields": line_fields,
    "keyword_scores": keyword_scores, "structural_scores": structural_scores, "context_scores": context_scores,
    "keyword_scores_rules": keyword_scores_rules, "layer_scores": layer_scores, "classify": classify,
    "classify_documents": classify_documents, "indicators": indicators, "confidence_band": confidence_band_q,
    "corpus_report": corpus_report, "suggest_fields": suggest_fields, "map_doc_type": map_doc_type,
    "render_prompt": render_prompt, "fallback_fields": fallback_fields, "rule_samples": rule_samples,
    "totals_scan": totals_scan, "totals_fields": totals_fields, "amounts_report": amounts_report,
    "order_reconcile": order_reconcile, "detect_tables": detect_tables, "explode_cells": explode_cells,
    "rebuild_tables": rebuild_tables, "sparse_tables": sparse_tables, "table_rects": table_rects, "table_cell_fields": table_cell_fields,
    "extract_quality": extract_quality, "doc_metrics": doc_metrics, "parse_samples": parse_samples,
    "valid_samples": valid_samples, "vote_doc_type": vote_doc_type, "sample_confidence": sample_confidence,
    "qa_merge": qa_merge, "field_consensus": field_consensus, "validate_fields": validate_fields,
    "totals_match": totals_match, "validation_summary": validation_summary, "source_locate": source_locate,
    "process_file": process_file, "process_fields": process_fields, "field_confidence": field_confidence, "overall_confidence": overall_confidence,
    "document_report": document_report, "export_json": export_json, "merge_fields": merge_fields,
    "eval_fields": eval_fields, "eval_metrics": eval_metrics, "eval_by_field": eval_by_field,
    "tfidf_vocab": tfidf_vocab, "tfidf_weights": tfidf_weights, "top_terms": top_terms,
    "nb_model": nb_model, "nb_predict": nb_predict, "hybrid_nb": hybrid_nb, "lr_predict": lr_predict,
    "kernel_predict": kernel_predict, "ensemble_predict": ensemble_predict, "hybrid_classify": hybrid_classify,
    "hybrid_untrained": hybrid_untrained, "retrain": retrain,
    "model_roundtrip": model_roundtrip, "classify_stream": classify_stream_q,
}
