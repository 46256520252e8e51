"""Benchmark decontamination by pigeonhole edit matching.

A test item occurs in a document when a stretch of the document is within its error budget of k edits.  Cut into k + 1
pieces, the item then has a piece that the stretch holds unchanged.  An Aho-Corasick automaton over the pieces of all
items finds these in one pass over the whole text; around each hit Myers' bit-parallel distance, with one bit for each
character of the item, verifies the stretch.  Overlapping windows of one item are merged first, so no character is
verified twice for an item.

Items travel to the executors in blocks of at most ITEM_BYTES; further blocks take further passes over the documents.

Texts are compared lower-cased with runs of white space as one space.  Items that are null or blank match nothing, as
do null and empty documents; equal items are reported each; a null doc_id is reported as null.  Documents of any
length are read whole; only doc_id and text are read of them, and item_id and text of the items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import keyed, ship_package, unkeyed

ITEM_BYTES = 8_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of almost equal length with their places in the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_stretch(item: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(edits, end) of the stretch of text nearest to item, the first of equal ones; None beyond k edits."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks = masks or match_masks(item)
    up, down, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up, right_down = right_up << 1 & full, right_down << 1 & full  # a stretch may start anywhere
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
        if score <= k and (best is None or score < best[0]):
            best = (score, end)
    return best


def match_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(item_id, t, budget(len(t), error_rate), match_masks(t)) for item_id, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, end in the normalised text) of the best stretch of each item within its budget."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, at in where:
                _, item, k, _ = self.items[n]
                start = end + 1 - length - at - k
                stop = start + len(item) + 2 * k
                own = windows.setdefault(n, [])
                own.append([max(start, 0), min(stop, len(text))])
        out = []
        for n, spans in windows.items():
            item_id, item, k, masks = self.items[n]
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                found = best_stretch(item, text[a:b], k, masks)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], found[1] + a)
            if best:
                out.append((item_id, *best))
        return out


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in blocks; one block at a time is held by the driver."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // ITEM_BYTES) or 1
    if count == 1:
        yield sorted((i, t) for i, t in ((r[0], normalise(r[1])) for r in items.collect()) if t)
        return
    for b in range(2 * count):  # hashed blocks of half the bound on average
        yield sorted((i, t) for i, t in ((r[0], normalise(r[1])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(2 * count)) == b).collect()) if t)


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05) -> DataFrame:
    """doc_id, item_id, edits, stop of every item that a document holds within error_rate edits a character; stop is
    the end of the best stretch in the normalised text."""
    return _find(docs.select(F.col("doc_id").alias("key"), "text"), benchmark, error_rate).withColumnRenamed("key", "doc_id")


def _find(rows: DataFrame, benchmark: DataFrame, error_rate: float) -> DataFrame:
    """The same for rows(key, text)."""
    spark = rows.sparkSession
    ship_package(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    types = dict(rows.dtypes)["key"]

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                found = [(i, *hit) for i, t in enumerate(batch.column("text")) for hit in matcher.find(normalise(t.as_py()))]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(at), pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                    ["key", "item_id", "edits", "stop"])
        return run

    passes = [rows.mapInArrow(scan(spark.sparkContext.broadcast(block)), f"key {types}, item_id long, edits int, stop int")
              for block in _blocks(items)]
    return reduce(DataFrame.union, passes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05) -> DataFrame:
    """docs without the rows that hold a benchmark item.  Every row is judged by its own text, whatever its doc_id; docs
    must be a table read from files, as a row is known by its place in them."""
    rows = keyed(docs)
    leaks = _find(rows.select(F.col("row").alias("key"), "kept.text"), benchmark, error_rate).select(F.col("key").alias("row")).distinct()
    return unkeyed(rows.join(leaks, "row", "left_anti"), docs.columns)
