"""Batches of files with failures set apart: good files into results, the others into quarantine with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources.intake import batch_status


def split_batch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that can be processed, and the others with their error."""
    judged = batch_status(files)
    return judged.filter("error IS NULL").drop("status", "error"), judged.filter("error IS NOT NULL").drop("status")


def start_batches(files: DataFrame, work: Callable[[DataFrame], DataFrame], results: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Runs `work` over the good files of every micro-batch of `files(doc_id, mime, size_bytes, text)`.

    Each batch writes into a folder of its own under both sinks, so one that runs again after a restart replaces what it
    had written and nothing is doubled.  A bad file never reaches `work`.
    """
    def run(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            good, bad = split_batch(rows)
            work(good).write.mode("overwrite").parquet(f"{results}/batch={number}")
            bad.select("doc_id", "error").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        finally:
            rows.unpersist()

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
