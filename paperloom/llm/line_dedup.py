"""Line deduplication within an edit bound, by a deletion-neighbourhood join.

Two lines match when they are equal, or when one edit (a character replaced, inserted or deleted) makes them equal and
the shorter has at least chars_per_edit characters.  A line is dropped when an earlier line, by doc_id and line number,
matches it; so the earliest of a group of equal lines always stays unless a near one stands before it.

Equal lines are one distinct line, found by digest.  Replaced and deleted characters leave equal variants: with
character i deleted on both sides (replacement), or on one side only (insertion).  All variants of a line within the
bound would be one per character, so the variants are narrowed down first, without losing a match:

1. An edit leaves one half of the line unchanged.  Only lines whose half occurs in another distinct line go on.
2. Within the other half, it leaves all but one of at most 32 pieces unchanged.  Only lines whose rest of that half
   occurs in another line go on, with that piece.
3. Of that piece all deletion variants are emitted as hashed keys.  Lines that share a variant of the same deleted
   position, or of which one is the other's variant, are within one edit by construction; each takes the earliest line
   of its key, by a minimum that combines before the shuffle, so no pairs of a group are listed.
4. The edit distance of each line and the earliest line it found is verified on the texts.

Lines end at line feeds and are compared without spaces, tabs and carriage returns at their ends.  Blank lines always
stay.  A null text has no lines, an empty text one blank line; a null doc_id comes before all others.  Rows that share
a doc_id, null included, are told apart by a row number, which also orders them; it is the row's place in the files
read, so ``docs`` must be a table read from files.  Repeated rows repeat the first one's lines.  Very long lines and
texts are compared whole; an empty table gives no rows.  Other columns, whatever their names, aren't read and come back
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import keyed, stored

PIECES = 32  # of a half line
PIECE_CHARS = 8  # at least


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row, line_no, raw, line (trimmed)."""
    return _lines(keyed(docs), text)


def _lines(rows: DataFrame, text: str) -> DataFrame:
    lines = F.posexplode(F.split(F.col(f"kept.`{text}`"), "\n")).alias("line_no", "raw")
    rows = rows.select(F.col("kept.doc_id").cast("long").alias("doc_id"), "row", lines)
    return rows.withColumn("line", F.expr("trim(BOTH ' \\t\\r' FROM raw)"))


def _place() -> Column:
    return F.struct("doc_id", "row", "line_no")


def _halves(chars_per_edit: int) -> Column:
    """Keys of the two halves, once with the line as the shorter or equal side of a pair (role S, base length n) and
    once as the longer side (role D, base length n - 1)."""
    def keys(base: str, role: str) -> str:
        return (f"named_struct('base', {base}, 'half', 0, 'role', '{role}', 'k1', xxhash64({base}, 0, right(line, {base} - {base} div 2))),"
                f"named_struct('base', {base}, 'half', 1, 'role', '{role}', 'k1', xxhash64({base}, 1, left(line, {base} div 2)))")
    return F.expr(f"filter(array({keys('n', 'S')}, {keys('(n - 1)', 'D')}), h -> h.base >= {chars_per_edit})")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key several distinct lines have, a shorter or equal side among them."""
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.max(F.col("role") == "S").alias("s")).where("lines > 1 and s").select(key)
    return rows.join(many, key, "left_semi")


#: Of a half [lo, hi) in base coordinates; the longer side has one character more in the edited piece.
_PIECES = f"""
transform(sequence(0, {PIECES - 1}), p -> named_struct('a', least(p * size, hi - lo), 'b', least((p + 1) * size, hi - lo)))
"""
_REST = """
transform(filter(pieces, p -> p.b > p.a), p -> named_struct(
  'k2', xxhash64(k1, p.a, substring(part, 1, p.a), substring(part, p.b + 1 + more)),
  'piece', substring(part, p.a + 1, p.b - p.a + more)))
"""
_VARIANTS = """
if(role = 'S',
   concat(transform(sequence(1, length(piece)), i -> named_struct('k3', xxhash64(k2, i, left(piece, i - 1), substring(piece, i + 1)), 'kind', 'S')),
          array(named_struct('k3', xxhash64(k2, 0, piece), 'kind', 'X'))),
   transform(sequence(1, length(piece)), i -> named_struct('k3', xxhash64(k2, 0, concat(left(piece, i - 1), substring(piece, i + 1))), 'kind', 'D')))
"""


def near_lines(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """place of a distinct line, place and distance of the earliest line within one edit that it found before it."""
    halves = distinct.select("doc_id", "row", "line_no", F.explode("halves").alias("h")).select("doc_id", "row", "line_no", "h.*")
    halves = stored(_shared(halves, "k1"), "line-halves")
    places = halves.select("row", "line_no").distinct().hint("merge")  # grows with the corpus: no broadcast at any size
    texts = stored(lines.join(places, ["row", "line_no"]).select("doc_id", "row", "line_no", "line"), "line-texts")
    parts = halves.join(texts.drop("doc_id"), ["row", "line_no"]).withColumns({
        "lo": F.expr("if(half = 0, 0, base div 2)"), "hi": F.expr("if(half = 0, base div 2, base)"),
        "more": F.expr("if(role = 'S', 0, 1)")}).withColumns({
        "size": F.expr(f"greatest({PIECE_CHARS}, cast(ceil((hi - lo) / {PIECES}.0) as int))"),
        "part": F.expr("substring(line, lo + 1, hi - lo + more)")})
    rests = parts.withColumn("pieces", F.expr(_PIECES)).select("doc_id", "row", "line_no", "role", F.explode(F.expr(_REST)).alias("r")).select("doc_id", "row", "line_no", "role", "r.*")
    rests = stored(_shared(rests, "k2"), "line-pieces")
    variants = rests.select("doc_id", "row", "line_no", F.explode(F.expr(_VARIANTS)).alias("v")).select(_place().alias("place"), "v.*")
    variants = stored(variants, "line-variants")
    # S: the same position deleted; X: the undeleted side of an insertion; D: its deleted side
    first = variants.groupBy("k3").agg(*[F.min(F.when(F.col("kind") == k, F.col("place"))).alias(k) for k in "SXD"])
    found = variants.join(first, "k3").withColumn("other", F.expr("case kind when 'S' then S when 'X' then D else X end")).where("other < place")
    found = found.groupBy("place").agg(F.min("other").alias("other"))
    by_place = texts.select(_place().alias("place"), "line")
    pairs = found.join(by_place, "place").join(by_place.select(F.col("place").alias("other"), F.col("line").alias("other_line")), "other")
    pairs = pairs.withColumn("edits", F.levenshtein("line", "other_line", 1)).where("edits between 0 and 1")
    return pairs.groupBy("place").agg(F.min("other").alias("other"), F.min("edits").alias("edits"))


def line_verdicts(docs: DataFrame, text: str = "text", chars_per_edit: int = 20) -> DataFrame:
    """doc_id, line_no, kept, match_doc_id, match_line_no, edits of every line: the earlier line that it repeats, if any."""
    return _verdicts(split_lines(docs, text), chars_per_edit).drop("row")


def _verdicts(lines: DataFrame, chars_per_edit: int) -> DataFrame:
    full = lines.where("line <> ''").withColumns({"n": F.length("line"), "digest": F.unhex(F.md5("line"))})
    distinct = full.withColumn("halves", _halves(chars_per_edit)).groupBy("digest").agg(F.min(_place()).alias("place"), F.first("halves").alias("halves"))
    distinct = stored(distinct.select("digest", "place.doc_id", "place.row", "place.line_no", "halves"), "distinct-lines")
    near = near_lines(full, distinct.where("size(halves) > 0"))
    known = distinct.select("digest", _place().alias("first")).join(near.withColumnRenamed("place", "first"), "first", "left")
    own = F.struct("row", "line_no")
    judged = full.select("doc_id", "row", "line_no", "digest").join(known, "digest")
    match = F.when(F.col("other").isNotNull(), F.col("other")).when(own != F.struct("first.row", "first.line_no"), F.col("first"))
    judged = judged.select("doc_id", "row", "line_no", match.isNull().alias("kept"), match.alias("m"), F.when(F.col("other").isNotNull(), F.col("edits")).when(match.isNotNull(), 0).alias("edits"))
    blank = lines.where("line = ''").select("doc_id", "row", "line_no", F.lit(True).alias("kept"), F.lit(None).cast("struct<doc_id:bigint,row:bigint,line_no:int>").alias("m"), F.lit(None).cast("int").alias("edits"))
    return judged.union(blank).select("doc_id", "row", "line_no", "kept", F.col("m.doc_id").alias("match_doc_id"), F.col("m.line_no").alias("match_line_no"), "edits")


def dedup_lines(docs: DataFrame, text: str = "text", chars_per_edit: int = 20) -> DataFrame:
    """docs with the repeated lines taken out of their texts; rows whose texts had no line to keep but blank ones go.
    A row without any line to drop is returned as it is."""
    rows = keyed(docs)
    drop = _verdicts(_lines(rows, text), chars_per_edit).where("not kept").groupBy("row").agg(F.collect_set("line_no").alias("drop"))
    rest = F.expr(f"array_join(filter(split(kept.`{text}`, '\\n'), (l, i) -> not array_contains(drop, i)), '\\n')")
    out = rows.join(drop, "row", "left").withColumn("rest", F.when(F.col("drop").isNotNull(), rest))
    out = out.where("drop is null or trim(BOTH ' \\t\\r\\n' FROM rest) <> ''")
    return out.select(*[F.when(F.col("drop").isNull(), F.col(f"kept.`{c}`")).otherwise(F.col("rest")).alias(c) if c == text else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
