"""Record sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per document, {"doc_id", "record"}, in one folder per document type (the type that its samples voted
    for).  Overwriting replaces the folders of the types that are written and no others, so a type can be run again, with
    the same result however often; a document that changes its type has to be run with both."""
    line = F.concat(F.lit('{"doc_id":'), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(',"record":'), F.col("record"), F.lit("}"))
    records.select("doc_type", line.alias("value")).write.partitionBy("doc_type").mode(mode).option(
        "partitionOverwriteMode", "dynamic").text(path)

