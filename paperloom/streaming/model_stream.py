"""The fallback model, refitted from a stream of labelled documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import ml


def start_retraining(stream: DataFrame, root: str, checkpoint: str, labels: list[int],
                     failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Each micro-batch of `stream(doc_id, text, label)` becomes a version of the model under root.

    A batch is refitted alone, as new samples replace the old ones.  A batch without a row to learn from, or one whose
    fit fails, leaves the version in use; ``failed`` hears of the latter.  Versions are named after the batch, so a
    batch that runs again after a restart writes the same version.
    """
    def refit(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            model = ml.FallbackModel.fit(rows, labels)
            if model.is_trained:
                ml.publish(batch.sparkSession, model, root, f"v{number:08d}")
        except Exception as e:
            if failed is None:
                raise
            failed(number, e)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(refit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
