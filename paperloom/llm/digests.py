"""Document fingerprints: quartile bucket digests with a bounded likeness.

A text's UTF-8 bytes are read as a ring.  Every byte gives one triplet with the bytes 5 and 11 places on; triplets are
hashed into 256 buckets and counted.  Each bucket is written as the quartile that its count falls in (two bits, 3 for
the top one), behind one byte for the length on a logarithmic scale.  Triplets that span several letters and often two
words depend on the text more than on its language, unlike three letters in a row.

Two digests are compared bucket by bucket: 0, 1, 2 or 6 for quartiles that lie 0, 1, 2 or 3 apart, as a share of what
two unrelated digests with the same quartile sizes would differ by, plus a small share for unlike lengths.  The
likeness is 1 less this, 0 at least; equal texts have equal digests and likeness 1.

Rows: null counts as empty; an empty text has the digest of zeros, which is unlike any other.  Texts of one or two
bytes are rings as well.  Long texts are read whole, in memory in proportion to their length.  Repeated rows give
repeated results, empty tables an empty one, and other columns than the named ones aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm._shared import ship_package, stored

BUCKETS = 256
STEPS = (5, 11)  # from a triplet's first byte to the others
BLOCK_BYTES = 4_000_000
LENGTH_BASE = 1.1
#: A length byte that is off by this or more costs LENGTH_SHARE of the likeness.
LENGTH_FAR, LENGTH_SHARE = 32, 0.25
_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)


def _bucket(data: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    value = data[at].astype(np.uint64)
    for shift, step in zip((8, 16), STEPS, strict=True):
        there = at + step
        over = np.flatnonzero(there >= start + size)
        there[over] = start[over] + (there[over] - start[over]) % size[over]
        value |= data[there].astype(np.uint64) << np.uint64(shift)
    return (W.mix(value + np.uint64(1)) >> np.uint64(64 - 8)).astype(np.int64)


def digests(texts: list[str]) -> np.ndarray:
    """One row for each text: the length byte, then the quartile of every bucket (0 to 3), each as a byte."""
    data, offsets = W.text_buffers(pa.array(texts, pa.large_string()))
    sizes = np.diff(offsets)
    out = np.zeros((len(texts), 1 + BUCKETS), np.uint8)
    row = 0
    while row < len(texts):
        stop = max(int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1, row + 1)
        n = sizes[row:stop]
        of = np.repeat(np.arange(stop - row), n)
        counts = np.zeros((stop - row) * BUCKETS, np.int64)
        for a in range(0, len(of), BLOCK_BYTES):  # a longer text is counted piece by piece
            part = of[a:a + BLOCK_BYTES]
            at = np.arange(a, a + len(part)) + offsets[row]
            bucket = _bucket(data, at, offsets[row:stop][part], n[part])
            counts += np.bincount(part * BUCKETS + bucket, minlength=len(counts))
        counts = counts.reshape(-1, BUCKETS)
        ranked = np.sort(counts, axis=1)
        for q in (1, 2, 3):
            out[row:stop, 1:] += counts > ranked[:, q * BUCKETS // 4 - 1][:, None]
        row = stop
    some = sizes > 0
    out[some, 0] = np.minimum(1 + np.floor(np.log(sizes[some]) / np.log(LENGTH_BASE)), 255)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the digests in the same row of both: 1 for equal ones, about 0 for unrelated ones, never outside 0 to 1."""
    if not len(a):
        return np.zeros(0)
    apart = _COST[a[:, 1:], b[:, 1:]].sum(axis=1)
    share_a = np.stack([(a[:, 1:] == v).sum(axis=1) for v in range(4)], axis=1)
    share_b = np.stack([(b[:, 1:] == v).sum(axis=1) for v in range(4)], axis=1)
    by_chance = ((share_a @ _COST) * share_b).sum(axis=1) / BUCKETS
    body = np.divide(apart, by_chance, out=np.zeros(len(a)), where=by_chance > 0)
    length = np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]), LENGTH_FAR) / LENGTH_FAR * LENGTH_SHARE
    return np.clip(1 - body - length, 0.0, 1.0)


def packed(rows: np.ndarray) -> list[str]:
    """Digests as lowercase hex: the length byte, then four buckets to a byte."""
    body = rows[:, 1:].reshape(len(rows), -1, 4)
    body = (body[:, :, 0] << 6) | (body[:, :, 1] << 4) | (body[:, :, 2] << 2) | body[:, :, 3]
    return [bytes(x).hex() for x in np.concatenate([rows[:, :1], body], axis=1).astype(np.uint8)]


def unpacked(texts: list[str | None]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(t or "00" * (1 + BUCKETS // 4) for t in texts)), np.uint8).reshape(len(texts), -1)
    body = np.stack([(raw[:, 1:] >> s) & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(texts), -1)
    return np.concatenate([raw[:, :1], body], axis=1)


def fingerprint(texts: str | Column) -> Column:
    """The digest of each whole text, in hex."""
    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(packed(digests([t or "" for t in column.to_pylist()])), pa.string())
    return of(texts)


def alike(a: str | Column, b: str | Column) -> Column:
    """The likeness of two digests; a null one counts as that of the empty text."""
    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(likeness(unpacked(x.to_pylist()), unpacked(y.to_pylist())), pa.float64())
    return of(a, b)


_EDGE = "struct<doc_id:bigint,hash:bigint,text:string,last_id:bigint,last_text:string>"
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _measured(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Columns of _OUT for texts whose next documents' texts are given."""
    n = [len(t) for t in texts]
    edited = [t[:k - k // 3] + after[:k // 3] for t, k, after in zip(texts, n, following, strict=True)]
    own, changed, after = digests(texts), digests(edited), digests(following)
    return [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(packed(own), pa.string()), pa.array(packed(changed), pa.string()),
            pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, after), pa.float64())]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered documents of a partition: all but the last one measured, and the partition's two ends."""
    first, held = None, None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "ends"]
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        if not ids:
            continue
        if first is None:
            first = (ids[0], batch.column("hash")[0].as_py(), texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = (ids[-1], texts[-1])
        if len(ids) > 1:
            none = pa.nulls(len(ids) - 1, pa.struct([("doc_id", pa.int64()), ("hash", pa.int64()), ("text", pa.string()), ("last_id", pa.int64()), ("last_text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*_measured(ids[:-1], texts[:-1], texts[1:]), none], names)
    if first is not None:
        ends = pa.array([{"doc_id": first[0], "hash": first[1], "text": first[2], "last_id": held[0], "last_text": held[1]}],
                        pa.struct([("doc_id", pa.int64()), ("hash", pa.int64()), ("text", pa.string()), ("last_id", pa.int64()), ("last_text", pa.string())]))
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([*blank, ends], names)


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = _measured(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("following").to_pylist())
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_neighbours(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document's digest beside that of an edited copy and of the next document.

    The next document is the one with the next smaller doc_id, after the last one the first; null doc_ids come last,
    rows of one doc_id by a hash of the text, then by the text.  The edited copy has its last third (code points,
    rounded down) replaced by as many from the start of the next document, or all that it has.

    Texts are dealt out once, by ranges of doc_id, and each task walks its range in order; only a range's last document
    looks for its partner among the ranges' first ones, one row for each range.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = [F.desc_nulls_last("doc_id"), F.asc("hash")]
    walked = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.asc("text"))
    walked = stored(walked.mapInArrow(_walk, f"{_OUT}, ends {_EDGE}"), "digests")
    ends = walked.where("ends is not null").select("ends.*")
    ring = Window.orderBy(*order)  # of one small row for each range
    first = ends.select("doc_id", "hash").withColumn("number", F.row_number().over(ring))
    first = first.withColumn("of", F.coalesce(F.lag("number").over(ring), F.max("number").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    same = F.col("e.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("e.hash") == F.col("f.hash"))
    numbered = ends.alias("e").join(first.alias("f"), same).select("e.text", "e.last_id", "e.last_text", "f.number", "f.of")
    pairs = numbered.alias("x").join(numbered.select("of", F.col("text").alias("following")).alias("y"), F.col("x.number") == F.col("y.of"))
    pairs = pairs.select(F.col("last_id").alias("doc_id"), F.col("last_text").alias("text"), "following")
    return walked.where("ends is null").drop("ends").union(pairs.mapInArrow(_last, _OUT))
