"""The corpus pipeline: five stages over the documents table, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage's result is written to the shared folder and
read back.  All but the last return the columns of documents.

Rows: a stage takes a table read from files and tells its rows apart by their place in them, so rows that share a doc_id
or have none are judged one by one.  Null and empty texts have no lines, shingles or items: they pass the filters that
don't reject them by their score.  Repeated rows lose their lines to the first of them.  Ties go to the smaller doc_id,
then to the row read first.  Very long texts are read whole, empty tables give empty ones, and further columns pass
through unchanged whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontaminate, jaccard, line_dedup, quality
from paperloom.llm._shared import keyed, stored, unkeyed
from paperloom.sources.tables import read_table

#: A document goes when label 1 is less likely than this.
KEEP_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels outside the held-out fifth."""
    machine = quality.train(docs, read_table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.score(docs, machine, *docs.columns).where(F.col("score") >= KEEP_SCORE).drop("score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; documents that had no other lines go with them.  n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that five-word shingles link at 75 %, the one with the smallest doc_id stays, of several such rows the
    first one read; null doc_ids come last.  Rows without words link with nothing and stay."""
    rows = keyed(docs)
    linked = jaccard.jaccard_join(rows.select(F.col("row").alias("doc_id"), "kept.text")).rows
    linked = linked.select(F.col("doc_id").alias("row"), "component_id")
    place = F.struct(F.col("kept.doc_id").isNull().alias("unnamed"), F.col("kept.doc_id").alias("doc_id"), "row")
    named = rows.select("row", place.alias("place")).join(linked, "row")
    stays = named.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row"))
    return unkeyed(rows.join(stays, "row", "left_semi"), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and n_tokens of every document left; texts whose ids don't decode to them would be marked."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "text"), tokenizer), tokenizer)
    return rows.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
                       (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_duplicate_stage),
          ("benchmark decontamination", decontamination_stage), ("BPE encoding", encoding_stage)]

#: A fitted classifier and exact edit matching have no SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
