"""Streaming classification: the batch transforms on a file stream.

Classification is a projection, so it needs no state and no watermark; late
files are simply classified when they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.classify import classify

DOCS_SCHEMA = "doc_id long, text string"


def read_document_stream(spark: SparkSession, path: str, schema: str = DOCS_SCHEMA,
                         files_per_trigger: int | None = None, glob: str = "*") -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_classification(docs: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Classify everything that is there and stop; a restart continues from the checkpoint."""
    return (classify(docs).drop("text").writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
