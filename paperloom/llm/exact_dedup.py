"""Exact deduplication with a stateful stream.

A file stream of documents is aggregated by digest into disk-backed state (RocksDB) that never expires: digest, number
of rows, and of the row with the largest identifier the identifier and where its content lies (file and row in it).
New files continue from the same state.  Hits, i.e. digests of several rows, are then checked in full bytes: their rows
are grouped by the whole text, which combines copies before the shuffle; a digest of several texts is split by text.

Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the largest doc_id stays; among
rows that share this doc_id, the one latest by file and position.  A null text counts as empty, empty texts are equal,
a null doc_id ranks below all others.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import shared_path, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many partitions: no 4 MB ahead for each
}


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII only take the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(docs: DataFrame, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = lower_ascii(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        norm.alias("norm")).withColumn("digest", digest(F.col("norm")))


def _keeper() -> Column:
    return F.max(F.struct("doc_id", "file", "row"))


def update_state(spark: SparkSession, path: str, checkpoint: str, text: str = "text",
                 digest: Callable[[Column], Column] = text_digest) -> DataFrame:
    """Streams the Parquet files below path that the checkpoint has not seen into its state, and returns the state:
    digest, keeper (doc_id, file, row), group_size."""
    found = f"{path[:-1]}[{path[-1]}]"  # as a pattern: a stream takes a plain path for a folder, this may be a file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(found)
    rows = _rows(stream, text, digest)
    state = rows.groupBy("digest").agg(_keeper().alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    with _settings(spark, STATE_CONF):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        names = kept.schema["value"].dataType.names
        # stored as read here: the state's own format is only known under these settings
        return stored(kept.select("key.digest", F.col(f"value.{names[0]}").alias("keeper"), F.col(f"value.{names[1]}").alias("group_size")), "dedup-state")


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, text: str = "text",
                digest: Callable[[Column], Column] = text_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of the Parquet files below path."""
    state = update_state(spark, path, checkpoint or shared_path(spark, "dedup-stream"), text, digest)
    rows = _rows(spark.read.parquet(path), text, digest)
    hits = rows.join(state.where("group_size > 1").select("digest"), "digest", "left_semi")
    texts = hits.groupBy("digest", "norm").agg(_keeper().alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    split = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    split = stored(split, "dedup-collisions")
    columns = ["doc_id", "file", "row", "text_sha256", "keeper", "group_size"]
    named = rows.withColumn("text_sha256", text_digest(F.col("norm")))
    if split.isEmpty():
        out = named.drop("norm").join(state, "digest").select(columns)
    else:  # different texts of one digest
        exact = texts.join(split, "digest", "left_semi")
        alone = named.join(split, "digest", "left_anti").drop("norm").join(state, "digest").select(columns)
        out = alone.union(named.join(exact, ["digest", "norm"]).select(columns))
    kept = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    return out.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
