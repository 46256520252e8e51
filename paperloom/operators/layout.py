"""Line layout: segmentation, element types, plot data sets.

A document's lines come from its own text, so everything that looks at one
document works inside the row (arrays of line structs) and only explodes at the
end; no shuffle by document is needed and a huge document cannot skew one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import element_type, strip

LINE_HEIGHT, CHAR_WIDTH, TEXT_HEIGHT = 25, 8, 20
IMAGE_CONFIDENCE, PDF_CONFIDENCE = 0.9, 0.95
GRID = 20
ELEMENT_TYPES = ("header", "financial", "currency", "date", "text")


def lines_array(text: Column) -> Column:
    """Non-blank lines as structs; blank lines still count for the line index."""
    numbered = F.transform(F.split(text, "\n"), lambda raw, i: F.struct(
        i.alias("line_idx"), raw.alias("raw"), strip(raw).alias("text")))
    return F.filter(numbered, lambda s: s["text"] != "")


def typed_lines(text: Column) -> Column:
    return F.transform(lines_array(text), lambda s: F.struct(
        s["line_idx"].alias("line_idx"), s["text"].alias("text"),
        element_type(s["raw"], s["text"]).alias("element_type")))


def segment_lines(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text[, mime])` to one row per non-blank line with an
    estimated box.  Other columns of docs are carried along."""
    conf = F.lit(PDF_CONFIDENCE)
    if "mime" in docs.columns:
        conf = F.when(F.col("mime").startswith("image/"), IMAGE_CONFIDENCE).otherwise(PDF_CONFIDENCE)
    keep = [c for c in docs.columns if c != "text"]
    split = docs.select(*keep, conf.alias("confidence"), F.posexplode(F.split("text", "\n")).alias("line_idx", "raw"))
    stripped = split.withColumn("text", strip(F.col("raw"))).filter(F.col("text") != "")
    return stripped.select(
        *keep, "line_idx", "text",
        F.lit(0.0).alias("x"), (F.col("line_idx") * float(LINE_HEIGHT)).alias("y"),
        (F.length("raw") * float(CHAR_WIDTH)).alias("w"), F.lit(float(TEXT_HEIGHT)).alias("h"),
        "confidence", element_type(F.col("raw"), F.col("text")).alias("element_type"))


def element_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "element_type").agg(F.count(F.lit(1)).alias("n_lines"))


def count_elements(docs: DataFrame) -> DataFrame:
    """`element_counts` of `docs(doc_id, text)`, counted in the row."""
    kinds = docs.select("doc_id", F.transform(typed_lines(F.col("text")), lambda s: s["element_type"]).alias("kinds"))

    def count(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("element_type"), F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias("n_lines"))

    counts = F.array(*map(count, ELEMENT_TYPES))
    return kinds.select("doc_id", F.explode(F.filter(counts, lambda c: c["n_lines"] > 0)).alias("c")).select("doc_id", "c.element_type", "c.n_lines")


def layout_points(lines: DataFrame) -> DataFrame:
    """Centre point, short label and marker size of every line."""
    label = F.when(F.length("text") > 30, F.concat(F.substring("text", 1, 30), F.lit("..."))).otherwise(F.col("text"))
    return lines.select(
        "doc_id", "line_idx", (F.col("x") + F.col("w") / 2).alias("cx"),
        (F.col("y") + F.col("h") / 2).alias("cy"), label.alias("label"),
        F.least(F.col("confidence") * 20, F.lit(15.0)).alias("size"), "element_type")


def confidence_grid(lines: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Mean line confidence per 20-pixel cell of the page image; lines carry
    image_width and image_height.  Positions beyond the image fall in the last
    cell.  With docs(doc_id, image_width, image_height) every cell of every
    document is returned, 0 where it has no line."""
    bins = lambda size: F.greatest(F.lit(1), F.floor(F.col(size) / GRID).cast("int"))
    cells = lines.select(
        "doc_id", "confidence", "x", "y", bins("image_width").alias("x_bins"), bins("image_height").alias("y_bins"))
    grid = cells.groupBy(
        "doc_id", "x_bins", "y_bins",
        F.least(F.floor(F.col("y") / GRID).cast("int"), F.col("y_bins") - 1).alias("y_idx"),
        F.least(F.floor(F.col("x") / GRID).cast("int"), F.col("x_bins") - 1).alias("x_idx"),
    ).agg(F.sum("confidence").alias("total"), F.count(F.lit(1)).alias("n_lines"))
    if docs is not None:
        grid = _every_cell(grid, docs.select("doc_id", bins("image_width").alias("x_bins"), bins("image_height").alias("y_bins")))
    mean = F.when(F.col("n_lines") > 0, F.col("total") / F.col("n_lines")).otherwise(0.0)
    return grid.select("doc_id", "y_idx", "x_idx", mean.alias("mean_confidence"), "n_lines")


def _every_cell(grid: DataFrame, sizes: DataFrame) -> DataFrame:
    """Filled cells, and the empty ones of `sizes(doc_id, x_bins, y_bins)`.  Only filled cells are shuffled: they meet the
    size of their grid in one row, which is then spelled out."""
    cell = F.struct("y_idx", "x_idx", "total", "n_lines")
    keys = ["doc_id", "x_bins", "y_bins"]
    filled = grid.select(*keys, cell.alias("cell"), F.lit(False).alias("whole"))
    whole = sizes.select(*keys, F.lit(None).cast(filled.schema["cell"].dataType).alias("cell"), F.lit(True).alias("whole"))
    per_doc = filled.unionByName(whole).groupBy(*keys).agg(F.collect_list("cell").alias("cells"), F.max("whole").alias("whole"))
    inside = F.filter("cells", lambda c: (c["y_idx"] >= 0) & (c["x_idx"] >= 0))
    taken = F.transform(inside, lambda c: c["y_idx"].cast("long") * F.col("x_bins") + c["x_idx"])
    places = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("y_bins").cast("long") * F.col("x_bins") - 1), taken)
    empty = F.transform(places, lambda p: F.struct(
        F.floor(p / F.col("x_bins")).cast("int").alias("y_idx"), (p % F.col("x_bins")).cast("int").alias("x_idx"),
        F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n_lines")))
    # a grid without a size of its own has its filled cells only
    every = F.concat("cells", F.when(F.col("whole"), empty).otherwise(F.array().cast(per_doc.schema["cells"].dataType)))
    return per_doc.select("doc_id", F.explode(every).alias("c")).select("doc_id", "c.y_idx", "c.x_idx", "c.total", "c.n_lines")


def line_fields(docs: DataFrame) -> DataFrame:
    """Document Date, Amount and Document Title from the last fitting line of a
    document; the last pass is an in-row filter."""
    lines = docs.select("doc_id", typed_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.explode(line_pairs("lines")).alias("p")).select(
        "doc_id", "p.name", "p.value").filter(F.col("value").isNotNull())


def line_pairs(lines: str) -> Column:
    """The same as an array of (name, value) made of a column of typed lines; NULL values for what is missing."""
    def last(kind: str, extra=None) -> Column:
        keep = F.filter(lines, lambda s: (s["element_type"] == kind) if extra is None
                        else (s["element_type"] == kind) & extra(s))
        return F.try_element_at(keep, F.lit(-1))["text"]

    return F.array(
        F.struct(F.lit("Document Date").alias("name"), last("date").alias("value")),
        F.struct(F.lit("Amount").alias("name"), last("currency").alias("value")),
        F.struct(F.lit("Document Title").alias("name"),
                 last("header", lambda s: F.length(s["text"]) > 5).alias("value")))
