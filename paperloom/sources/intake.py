"""File intake: reading, routing, size gates, method chain, page assembly, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import scores
from paperloom.functions.text import strip

MIME_BY_EXTENSION = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
                     "jpeg": "image/jpeg", "txt": "text/plain"}


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder: path, mime, size_bytes, content.  Selecting without
    content never opens the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path)
    ext = F.lower(F.substring_index("path", ".", -1))
    mime = None
    for e, m in MIME_BY_EXTENSION.items():
        mime = F.when(ext == e, m) if mime is None else mime.when(ext == e, m)
    return files.select("path", mime.otherwise("application/octet-stream").alias("mime"),
                        F.col("length").alias("size_bytes"), "content")


def route(files: DataFrame) -> DataFrame:
    """pdf, image or unsupported; recognised files take the ocr method."""
    kind = (F.when(F.col("mime") == "application/pdf", "pdf")
            .when(F.col("mime").startswith("image/"), "image").otherwise("unsupported"))
    return files.withColumn("route", kind).withColumn(
        "method", F.when(F.col("route") == "unsupported", "text").otherwise("ocr"))


def size_gate(files: DataFrame) -> DataFrame:
    """Direct parsing is refused above 2 MiB or above the estimated token limit."""
    sized = files.withColumns({
        "size_mb": F.col("size_bytes") / F.lit(1048576.0),
        "base64_chars": 4 * F.ceil(F.col("size_bytes") / 3)})
    tokens = F.col("base64_chars") * F.lit(rules.TOKENS_PER_CHAR)
    gate = (F.when(F.col("size_mb") > rules.DIRECT_LIMIT_MB, "too_large")
            .when(tokens > rules.DIRECT_LIMIT_TOKENS, "too_many_tokens").otherwise("direct"))
    return sized.withColumn("est_tokens", tokens).withColumn("gate", gate)


def choose_method(candidates: DataFrame) -> DataFrame:
    """First successful extraction of direct, images and basic text, with its
    quality.  Candidates hold direct_text, images_text, basic_text (NULL when
    that path failed), n_lines and n_tables."""
    d, i, b = F.col("direct_text"), F.col("images_text"), F.col("basic_text")
    method = (F.when(d.isNotNull(), "direct").when(i.isNotNull(), "images")
              .when(b.isNotNull(), "basic").otherwise("failed"))
    quality = (F.when(d.isNotNull(), scores.quality_direct(d, F.col("n_tables")))
               .when(i.isNotNull(), scores.quality_image(i, F.col("n_lines"), F.col("n_tables")))
               .when(b.isNotNull(), F.lit(scores.QUALITY_BASIC)).otherwise(F.lit(scores.QUALITY_FAILED)))
    return candidates.withColumns({"method": method, "text": F.coalesce(d, i, b), "quality": quality})


def assemble_pages(pages: DataFrame) -> DataFrame:
    """`pages(doc_id, page, text)` (page from 0) to one row per document.

    joined_text: all pages with page-break markers.  basic_text: blank pages
    dropped, the others under a page header, separated by blank lines; NULL for
    a document of blank pages only, which has the status "blank".
    """
    grouped = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    filled = F.filter("p", lambda s: strip(s["text"]) != "")
    headed = F.transform(filled, lambda s: F.concat(
        F.lit("--- Page "), (s["page"] + 1).cast("string"), F.lit(" ---\n"), s["text"]))
    some = F.size(headed) > 0
    return grouped.select(
        "doc_id", F.size("p").alias("n_pages"),
        F.array_join(F.transform("p", lambda s: s["text"]), rules.PAGE_BREAK).alias("joined_text"),
        F.when(some, F.array_join(headed, "\n\n")).alias("basic_text"),
        F.when(some, "text").otherwise("blank").alias("status"))


def batch_status(files: DataFrame) -> DataFrame:
    """Per-file outcome of a batch: a file that cannot be processed is marked and
    never stops the others.  Files hold mime, size_bytes and text."""
    error = (F.when(F.col("mime").isNull(), "missing type")
             .when(F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "unreadable size")
             .when(F.col("text").isNull(), "no text")
             .when(strip(F.col("text")) == "", "empty document"))
    return files.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
