"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The pairwise part is the sum-of-squares identity, so scoring is linear in a text's features.  Features are sparse:
the distinct words of the whole text, hashed into 2^15 buckets and weighted 1/sqrt(number of buckets), and one bucket for
the value range of each structure statistic and of n_chars.  Labels, language, source and identifiers are no features.

The machine is fitted on the driver on at most max_rows labelled texts (lowest identifier hashes, a documented bound);
their features are computed by Spark.  Scoring covers every whole text and needs no shuffle.

Rows: null and empty texts are scored on their statistics; a null n_chars has a range of its own; labels other than 0
and 1 are ignored, of several labels of a document the largest counts; repeated rows are scored alike; other columns
are not read.  Without labelled rows of both classes the share of label 1 (0.5 where there is none) is every score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm._shared import ship_package

WORD_BUCKETS = 1 << 15
BINS = 24  # value ranges of a statistic
_CLASSES = ("upper", "lower", "digit", "mark", "bang", "sign", "beyond", "space", "line")
_STATS = 15
FEATURES = WORD_BUCKETS + _STATS * BINS


def _byte_classes() -> np.ndarray:
    c = np.full(256, _CLASSES.index("mark"), np.int64)
    c[65:91], c[97:123], c[48:58], c[128:] = 0, 1, 2, _CLASSES.index("beyond")
    c[[ord("!"), ord("?")]] = _CLASSES.index("bang")
    c[[ord(x) for x in "#$%&*|<>{}[]\\^~=+@_"]] = _CLASSES.index("sign")
    c[[32, 9, 11, 12, 13]] = _CLASSES.index("space")
    c[10] = _CLASSES.index("line")
    return c


_BYTE_CLASS = _byte_classes()


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(2 * np.log2(1 + x)), BINS - 2).astype(np.int64)


def _share_bin(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.sqrt(x / np.maximum(of, 1)) * (BINS - 1)), BINS - 2).astype(np.int64)


def features(texts: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket, weight and start of each text's features; block after block."""
    for block in W.blocks(texts):
        count = len(block.text) - 1
        words = np.diff(block.first)
        length = np.diff(block.text)
        kind = _BYTE_CLASS[block.data]
        by_class = []
        for c in range(len(_CLASSES)):
            sums = np.concatenate([[0], np.cumsum(kind == c)])
            by_class.append(sums[block.text[1:]] - sums[block.text[:-1]])
        upper, lower, digit, mark, bang, sign, beyond, space, line = by_class
        buckets = (block.hash % np.uint64(WORD_BUCKETS)).astype(np.int64)
        ids, weights, starts, distinct, most, pairs = [], [], [0], np.zeros(count), np.zeros(count), np.zeros(count)
        for i, (a, b) in enumerate(zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True)):
            found, times = np.unique(buckets[a:b], return_counts=True)
            distinct[i], most[i] = len(found), times.max(initial=0)
            pairs[i] = len(np.unique(buckets[a:b - 1] * WORD_BUCKETS + buckets[a + 1:b])) if b - a > 1 else 0
            ids.append(found)
        rows = np.arange(block.row, block.row + count)
        known = n_chars[rows] >= 0
        stats = np.stack([
            _log_bin(length), _log_bin(words), _share_bin(upper, upper + lower), _share_bin(digit, length), _share_bin(mark, length),
            _share_bin(bang, words), _share_bin(sign, length), _share_bin(beyond, length), _share_bin(space, length),
            _share_bin(line, words), _log_bin((length - space - line) / np.maximum(words, 1)),
            _share_bin(distinct, words), _share_bin(most, words), _share_bin(pairs, np.maximum(words - 1, 1)),
            np.where(known, _log_bin(np.maximum(n_chars[rows], 0)), BINS - 1)], axis=1)
        stats = WORD_BUCKETS + np.arange(_STATS) * BINS + stats
        merged = []
        for i in range(count):
            merged.append(ids[i])
            merged.append(stats[i])
            weights.append(np.full(len(ids[i]), 1 / np.sqrt(max(len(ids[i]), 1)), np.float32))
            weights.append(np.ones(_STATS, np.float32))
            starts.append(starts[-1] + len(ids[i]) + _STATS)
        yield np.concatenate(merged), np.concatenate(weights), np.array(starts)


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factors[ids] * x[:, None]
        total = np.add.reduceat(vx, starts[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts[:-1])
        return self.bias + np.add.reduceat(self.linear[ids] * x, starts[:-1]) + 0.5 * ((total * total).sum(axis=1) - squares)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 6, epochs: int = 8, rate: float = 0.02,
        decay: float = 1e-4, seed: int = 7) -> Machine:
    """Minibatch gradient steps with per-coordinate step sizes on the logistic loss."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    w, v = np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, rank)).astype(np.float32)
    if not len(labels) or not 0 < share < 1:
        return Machine(30.0 if share == 1 else -30.0 if len(labels) else 0.0, w, np.zeros_like(v))
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, rank), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            take = order[at:at + 64]
            ids, x = np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take])
            starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in take])])
            owner = np.repeat(np.arange(len(take)), np.diff(starts))
            vx = v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts[:-1], axis=0)
            error = (_sigmoid(Machine(bias, w, v).margins(ids, x, starts)) - labels[take]).astype(np.float32)
            own = error[owner] * x / len(take)
            used, slot = np.unique(ids, return_inverse=True)
            dw = np.bincount(slot, weights=own, minlength=len(used)).astype(np.float32) + decay * w[used]
            pull = own[:, None] * (total[owner] - vx)
            dv = np.stack([np.bincount(slot, weights=pull[:, f], minlength=len(used)) for f in range(rank)], axis=1).astype(np.float32) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * 5 * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            db = float(error.mean())
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return Machine(bias, w, v)


def _n_chars(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("n_chars").cast(pa.int64()).fill_null(-1))


def _inputs(docs: DataFrame, *columns: str) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(*columns, "text", n.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8192) -> Machine:
    """labels(doc_id, <label>): the rows that may be learnt from; at most max_rows of them are, and of several documents
    that share a doc_id the one with the least text."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, at = np.asarray(batch.column("y")), 0
            for ids, x, starts in features(batch.column("text"), _n_chars(batch)):
                n = len(starts) - 1
                offsets = pa.array(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(y[at:at + n]), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(x))], ["y", "ids", "x"])
                at += n

    rows = _inputs(docs, "doc_id").join(F.broadcast(known), "doc_id")  # of max_rows rows at most
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "y")).alias("r")).select("r.*")
    table = rows.select("y", "text", "n_chars").mapInArrow(extract, "y int, ids array<int>, x array<float>").toArrow()
    ids, x = table["ids"].combine_chunks(), table["x"].combine_chunks()
    ends = np.asarray(ids.offsets)
    flat, weights = np.asarray(ids.values), np.asarray(x.values)
    found = sorted(((flat[a:b].astype(np.int64), weights[a:b], y) for a, b, y in zip(ends[:-1], ends[1:], table["y"].to_pylist(), strict=True)),
                   key=lambda r: (r[2], len(r[0]), r[0].tobytes()))  # the order of arrival must not matter
    return fit([r[:2] for r in found], np.array([r[2] for r in found], np.float64))


def score(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """The kept columns and the score of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(machine))  # FEATURES x (rank + 1) numbers
    rows = _inputs(docs, *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine(*shared.value)
        for batch in batches:
            parts = [_sigmoid(model.margins(*f)) for f in features(batch.column("text"), _n_chars(batch))]
            scores = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(scores)], [*batch.schema.names[:len(keep)], "score"])

    types = dict(docs.dtypes)
    out = rows.mapInArrow(run, ", ".join([f"_keep{i} {types[c]}" for i, c in enumerate(keep)] + ["score double"]))
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "score")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
