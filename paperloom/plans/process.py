"""The whole document process as one plan: classify, vote, merge samples, validate, trace, score, override."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import scores
from paperloom.functions.checks import field_valid
from paperloom.functions.text import parse_number
from paperloom.operators import layout, ml, tables, totals
from paperloom.operators import samples as S
from paperloom.operators.classify import classify, with_indicators
from paperloom.operators.locate import source_line, with_source
from paperloom.operators.merge import merge_fields
from paperloom.operators.suggest import output_type
from paperloom.operators.validate import totals_aggregates, totals_outcome

CARRIED = ("text", "recognised")


def rules_only(classified: DataFrame) -> DataFrame:
    """The choice without a trained model."""
    return ml.FallbackModel([rules.TYPE_ORD[t] for t in rules.RULE_TYPES]).hybrid(classified, carry=CARRIED)


def with_model(model: ml.FallbackModel | ml.Bayes) -> Callable[[DataFrame], DataFrame]:
    """The hybrid choice with a model."""
    if isinstance(model, ml.Bayes):
        return lambda classified: ml.hybrid_nb(classified, model, carry=CARRIED)
    return lambda classified: model.hybrid(classified, carry=CARRIED)


def recognised(mime):
    """Whether a file's text comes from a recogniser: only then have values a place, and prescriptions a type."""
    return F.coalesce((mime == "application/pdf") | mime.startswith("image/"), F.lit(False))


def scored_fields(docs: DataFrame, raw_samples: DataFrame, choose: Callable[[DataFrame], DataFrame] = rules_only) -> DataFrame:
    """Consensus fields with validity, source and final confidence, one row per
    (document, name), plus one row with NULL name for a document without fields.

    `docs(doc_id, text, mime)` is classified on the way, by the rules and by `choose` where they are unsure, and joined
    once, a document's fields and votes in one row; its text is used for the source line and not shuffled again.  The type that it maps to is the hint for samples
    that name none; the samples' vote is the record's type.
    """
    parsed = S.valid_samples(S.parse_samples(raw_samples), F.lit(None).cast("string"))
    classed = choose(with_indicators(classify(docs.select("doc_id", "text", recognised(F.col("mime")).alias("recognised")))))
    classed = classed.withColumnsRenamed({"doc_type": "class_type", "confidence": "class_confidence"})
    hinted = classed.withColumn("output_type", output_type(F.col("class_type"), F.col("text"), F.col("recognised")))
    # one row for each document meets its text; only then its fields become rows
    voted = hinted.join(S.consensus_and_votes(parsed), "doc_id", "left").withColumns(
        {"vote": S.voted_type(F.col("votes"), F.col("output_type")), "low": F.lower("text")})
    joined = voted.select("*", F.explode_outer("fields").alias("f")).select("*", "f.*").withColumnRenamed("confidence", "model_confidence")
    checked = joined.withColumns({
        "valid": field_valid(F.col("norm_name"), F.col("value")),
        "line_idx": F.when(F.col("recognised"), source_line(F.col("value"), F.col("text"), F.col("low")))})
    placed = with_source(checked)
    model = F.when(F.col("model_confidence") == 0, 0.7).otherwise(F.col("model_confidence"))
    consensus_strength = F.when(F.col("n_samples") > 1, 1.0).otherwise(0.7)
    return placed.select(
        "doc_id", "class_type", "class_confidence", "confidence_level", "decided_by", "output_type",
        F.col("vote.doc_type").alias("doc_type"), F.col("vote.n").alias("n_votes"),
        F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "norm_name", "name", "value", "ord", "valid",
        "line_idx", "page", "bbox", "model_confidence", "source_confidence",
        F.when(F.col("norm_name").isNotNull(), scores.field_confidence(
            model, F.col("source_confidence"), F.col("valid"), consensus_strength)).alias("confidence"))


def extracted_fields(docs: DataFrame, raw_samples: DataFrame) -> DataFrame:
    """The fields that a document ends up with: doc_id, name, value, source.  What samples agree on is overridden by
    fields from table cells, totals and labelled lines, where a recogniser has read the document.

    `docs(doc_id, text, mime, tables_json)`."""
    parsed = S.valid_samples(S.parse_samples(raw_samples))
    agreed = S.field_consensus(S.sample_fields(parsed)).select("doc_id", "name", "value", "ord")
    read = docs.filter(recognised(F.col("mime")))
    answers = tables.parse_tables(read.select("doc_id", F.col("tables_json").alias("json")))
    return merge_fields(base=agreed, table=tables.table_cell_fields(tables.explode_cells(answers)),
                        totals=totals.totals_fields(totals.scan_totals(read)), line=layout.line_fields(read))


def document_results(fields: DataFrame) -> DataFrame:
    """Scored fields to one row per document."""
    named = fields.withColumn("num", parse_number(F.col("value")))
    per_doc = named.groupBy("doc_id", "doc_type", "n_votes", "class_type", "class_confidence", "confidence_level", "decided_by", "output_type", "n_samples").agg(
        F.count("norm_name").alias("n_names"), F.sum(F.col("valid").cast("int")).alias("n_valid"),
        F.avg("confidence").alias("mean_field"),
        F.sum(F.when(F.col("norm_name").isNotNull() & (F.col("model_confidence") < 0.5), 1).otherwise(0)).alias("n_low"),
        F.sum(F.when(F.col("line_idx").isNotNull(), 1).otherwise(0)).alias("n_located"),
        *totals_aggregates())
    rate = F.when(F.col("n_names") > 0, F.col("n_valid") / F.col("n_names")).otherwise(0.0)
    out = per_doc.withColumn("pass_rate", rate)
    return out.select(
        "doc_id", "doc_type", "n_votes", "class_type", "output_type",
        F.col("class_confidence").alias("classification_confidence"), "confidence_level", "decided_by", "n_samples", "n_names",
        "n_located", "pass_rate",
        F.when(F.col("n_low") > 0, F.concat(F.col("n_low").cast("string"), F.lit(" low-confidence fields"))).alias("notes"),
        totals_outcome().alias("totals_match"),
        scores.overall_confidence(F.col("mean_field"), F.col("class_confidence"), F.col("pass_rate")).alias("overall_confidence"))


def process_documents(docs: DataFrame, raw_samples: DataFrame, choose: Callable[[DataFrame], DataFrame] = rules_only) -> DataFrame:
    return document_results(scored_fields(docs, raw_samples, choose))


def type_report(results: DataFrame) -> DataFrame:
    """Headline figures per document type."""
    return results.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("overall_confidence").alias("mean_overall"),
        F.avg("pass_rate").alias("mean_pass_rate"),
        F.sum(F.when(F.col("totals_match") == "passed", 1).otherwise(0)).alias("totals_passed"),
        F.sum(F.when(F.col("totals_match") == "failed", 1).otherwise(0)).alias("totals_failed"),
        F.sum("n_located").alias("n_located"))
