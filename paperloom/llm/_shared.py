"""Small helpers that several operators of this package use."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import work_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: it is computed once, and a lost executor costs nothing
    that was finished."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, kept): a number of each row's own beside the row as one struct, so that no caller's column can clash and
    rows that share a doc_id stay apart.  The number is the row's place in the files read: ``docs`` must be a table read
    from files (as every stage's input is), for which it comes out alike whenever it is computed."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))


def unkeyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"kept.`{c}`").alias(c) for c in columns])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this library's source to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "paperloom_src.zip"  # Spark's file server serves it from here
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
