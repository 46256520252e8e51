"""Phrase collocation mining by best-first branch-and-bound growth.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
Within a language, a phrase of two or three words that occurs a >= least times is a candidate.  A cut after its first k
words gives floor(10^6 * a * a / (l * r)), l and r being how often the parts occur; the lowest cut is its score.  A
candidate is dropped when a longer candidate that holds it occurs at least half as often.

1. Words are counted, then pairs whose words occur often enough: a phrase is no more frequent than any part of it.
2. A pair with count a and first word count l is a prefix; as a three-word phrase's count is no larger than those of its
   prefix and of its end, no extension scores above floor(10^6 * a / l).  This bound also covers the pair's own score.
3. Growth is best-first, in rounds: each language has a level, and the prefixes not yet grown whose bound reaches it
   are grown, by counting their extensions in all documents; likewise the prefixes that could form a phrase that drops
   a pair at or above the level (their second word is the pair's first, and they occur at least half as often).  Now
   all survivors at or above the level are known.  A language is settled when these are ``top`` or more, ties included,
   or when nothing is left to grow; for the others the level falls by the rank GROWTH times as deep, so a language needs
   a number of rounds that grows with the logarithm of its pairs.
4. The survivors at or above the score that closes the list are ranked with their texts.

Counts are made per task from sorted hash arrays and added up in Spark.  A word is a 64-bit hash of (language, bytes);
where two words share
one that occurs often enough, all starts anew with another seed, so the counts are exact.  Which words and prefixes count
is told to the tasks by bitmaps of a fixed size: a position that several share only lets rows through that the exact
joins and counts behind it remove, so with very many words the bitmaps stop helping but nothing is lost.

Rows: null texts are empty, a null lang is ``und``; empty tables give no rows.  Long texts are read whole.  Repeated rows
count each.  Ties in score and count are ranked by the phrase's UTF-8 bytes.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as numbers
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm._shared import ship_package, stored

BITMAP_BITS = 24  # 2^24 bits: 2 MB
FLUSH_WORDS = 2_000_000  # counted in a task at once
GROWTH = 4
MILLION = 1_000_000

_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens(NamedTuple):
    hash: np.ndarray  # of each word with its language
    joined: np.ndarray  # whether the next word follows in the same piece
    row: np.ndarray  # of the batch
    start: np.ndarray  # in data
    end: np.ndarray
    data: np.ndarray  # lower-cased bytes


def _tokens(batch: pa.RecordBatch, seed: int) -> Iterator[Tokens]:
    """Words of a batch of (lang, text), in blocks of whole texts."""
    salt = {v: int.from_bytes(hashlib.blake2b(f"{seed}:{v}".encode(), digest_size=8).digest(), "little") for v in set(batch.column("lang").to_pylist())}
    salts = np.array([salt[v] for v in batch.column("lang").to_pylist()], np.uint64)
    data, offsets = W.text_buffers(batch.column("text"))
    row = 0
    while row < len(offsets) - 1:
        stop = max(int(np.searchsorted(offsets, offsets[row] + W.BLOCK_BYTES, side="right")) - 1, row + 1)
        text, raw = offsets[row:stop + 1] - offsets[row], _LOWER[data[offsets[row]:offsets[stop]]]
        n = len(raw)
        cut = _CUT[raw]
        inside = ~(cut | _GAP[raw])
        edge = np.zeros(n + 1, bool)
        edge[text] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
        start, end = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
        if len(start):
            size = end - start
            power = np.full(int(size.max()), 0x9E3779B97F4A7C15 + 2 * seed, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            # a word's bytes are the only ones that count from its start up to the next one's
            place = np.arange(n) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [n]])))
            value = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * power[np.where(inside, place, 0)], np.uint64(0))
            of = np.searchsorted(text, start, side="right") - 1
            h = W.mix(np.add.reduceat(value, start) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            h = W.mix(h ^ salts[row:stop][of])
            cuts = np.concatenate([[0], np.cumsum(cut)])
            joined = np.zeros(len(start), bool)
            joined[:-1] = (of[1:] == of[:-1]) & (cuts[start[1:]] == cuts[end[:-1]])
            yield Tokens(h, joined, row + of, start, end, raw)
        row = stop


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first of each run of equal keys in an order that brings equal keys together, and run lengths;
    keys of different value that mix alike may split a run."""
    mixed = keys[0]
    for k in keys[1:]:
        mixed = W.mix(mixed) ^ k
    order = np.argsort(mixed)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.concatenate([first, [len(order)]]))


def _words(seed: int):
    """(lang, text) -> counted words of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for t in _tokens(batch, seed):
                at, n = _runs([t.hash])
                raw = t.data.tobytes()
                texts = [raw[a:b] for a, b in zip(t.start[at].tolist(), t.end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(t.row[at])), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(t.hash[at].view(np.int64)), pa.array(n)], ["lang", "word", "hash", "n"])
    return run


def _position(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Of a word's or a pair's hash in a bitmap; the same as _position_sql."""
    key = hashes[0]
    if len(hashes) > 1:
        key = key ^ ((hashes[1] << np.uint64(21)) | (hashes[1] >> np.uint64(43)))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _position_sql(columns: list[str], bits: int) -> str:
    key = columns[0] if len(columns) == 1 else f"({columns[0]} ^ (shiftleft({columns[1]}, 21) | shiftrightunsigned({columns[1]}, 43)))"
    return f"({key} & {(1 << bits) - 1}L)"


def _bitmap(spark: SparkSession, rows: DataFrame, columns: list[str], bits: int):
    """Broadcast bitmap of the rows' positions: 2^bits bits, whatever the number of rows."""
    at = rows.select(F.expr(_position_sql(columns, bits)).alias("at"))
    masks = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow()
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[np.asarray(masks["word"])] = np.asarray(masks["mask"])
    return spark.sparkContext.broadcast(packed)


def _marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _phrases(seed: int, size: int, bits: int, known, grown):
    """(lang, text) -> counted phrases of ``size`` words: pairs of known words, or known pairs end to end of which the
    first is to be grown."""
    names = [f"h{i}" for i in range(1, size + 1)] + ["n"]

    def counted(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        keys = [np.concatenate(p) for p in zip(*parts, strict=True)]
        at, n = _runs(keys)
        return pa.RecordBatch.from_arrays([*(pa.array(k[at].view(np.int64)) for k in keys), pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for t in _tokens(batch, seed):
                h, joined = t.hash, t.joined
                if size == 2:
                    often = _marked(known.value, _position([h], bits))
                    at = np.flatnonzero(joined[:-1] & often[:-1] & often[1:])
                else:
                    pair = _position([h[:-1], h[1:]], bits)
                    both = joined[:-1].copy()
                    both[both] = _marked(known.value, pair[both])
                    at = np.flatnonzero(both[:-1] & both[1:])
                    at = at[_marked(grown.value, pair[at])]
                if len(at):
                    parts.append([h[at + i] for i in range(size)])
                    held += len(at)
                if held >= FLUSH_WORDS:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    return run


def _counted(texts: DataFrame, size: int, least: int, *args) -> DataFrame:
    keys = [f"h{i}" for i in range(1, size + 1)]
    rows = texts.mapInArrow(_phrases(args[0], size, *args[1:]), ", ".join(f"{k} long" for k in keys) + ", n long")
    return rows.groupBy(*keys).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 * a * a / (l * r)) in whole numbers of 38 digits: exact for counts below 10^16."""
    wide = "decimal(38,0)"
    return F.expr(f"cast((cast({a} as {wide}) * cast({a} as {wide}) * {MILLION}) div (cast({left} as {wide}) * cast({right} as {wide})) as bigint)")


def _vocabulary(texts: DataFrame, least: int) -> tuple[int, DataFrame]:
    """(lang, word, hash, n), and a seed under which no two words share a hash that occurs often enough to count."""
    for seed in numbers():
        rows = texts.mapInArrow(_words(seed), "lang string, word string, hash long, n long")
        rows = stored(rows.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")), "words")
        shared = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
        if shared.where((F.col("words") > 1) & (F.col("n") >= least)).isEmpty():
            return seed, rows


def _levels(pairs: DataFrame, rank: int) -> DataFrame:
    """(lang, level): the highest score that at least ``rank`` of a language's pairs reach, 0 where it has fewer.
    Pairs are counted per score before the running sum; a score is one of 10^6 + 1 whole numbers."""
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    reached = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("c")).withColumn("reached", F.sum("c").over(down))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached") >= rank, F.col("score"))), F.lit(0)).alias("level"))


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, least: int = 10, bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` surviving phrases."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    seed, every = _vocabulary(texts, least)
    words = stored(every.where(F.col("n") >= least), "frequent-words")
    pairs = _counted(texts, 2, least, seed, bits, _bitmap(spark, words, ["hash"], bits), None)
    first = words.select(F.col("hash").alias("h1"), "lang", F.col("n").alias("l"))
    second = words.select(F.col("hash").alias("h2"), F.col("n").alias("r"))
    pairs = pairs.join(first, "h1").join(second, "h2").withColumns({"score": _score("a", "l", "r"), "bound": _score("a", "l", "a")})
    pairs = stored(pairs.select("lang", "h1", "h2", "a", "l", "r", "score", "bound"), "pairs")
    known = _bitmap(spark, pairs, ["h1", "h2"], bits)

    grown, triples, settled, rank = None, None, None, top
    while True:
        rank *= GROWTH
        level = _levels(pairs, rank)
        if settled is not None:
            level = level.join(settled, "lang", "left_anti")
        level = stored(level, "levels")
        wanted = pairs.join(F.broadcast(level), "lang")  # a row for each language
        dropping = wanted.where("score >= level").groupBy(F.col("h1").alias("h2")).agg(F.min("a").alias("held"))
        frontier = wanted.join(dropping, "h2", "left").where("bound >= level or 2 * a >= held").select("h1", "h2")
        if grown is not None:
            frontier = frontier.join(grown, ["h1", "h2"], "left_anti")
        frontier = stored(frontier, "frontier")
        found = _counted(texts, 3, least, seed, bits, known, _bitmap(spark, frontier, ["h1", "h2"], bits))
        found = stored(found.join(frontier, ["h1", "h2"], "left_semi"), "triples")
        grown = frontier if grown is None else grown.union(frontier)
        triples = found if triples is None else triples.union(found)
        survivors = stored(_survivors(pairs, triples, words), "survivors")
        enough = survivors.join(F.broadcast(level), "lang").where("score >= level").groupBy("lang").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= top)
        done = stored(enough.select("lang").union(level.where("level = 0").select("lang")).distinct(), "settled")
        settled = done if settled is None else settled.union(done)
        if level.join(done, "lang", "left_anti").isEmpty():
            return _ranked(survivors, words, every, top)


def _survivors(pairs: DataFrame, triples: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, h1, h2, h3, a, l, r, score) of the pairs that no known three-word phrase drops, and of those phrases."""
    start = pairs.select("lang", "h1", "h2", F.col("l").alias("f1"), F.col("a").alias("f12"))
    end = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    three = triples.join(start, ["h1", "h2"]).join(end, ["h2", "h3"]).withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    by_first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "h1", "h2", "h3", "a", F.when(by_first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(by_first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    inside = triples.select("h1", "h2", "a").union(triples.select("h2", "h3", "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    two = pairs.join(inside, ["h1", "h2"], "left").where("longer is null or 2 * longer < a")
    return two.select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", "l", "r", "score").union(three)


def _ranked(survivors: DataFrame, words: DataFrame, every: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    listed = survivors.withColumn("place", F.rank().over(best)).where(F.col("place") <= top)  # with all ties of the last
    for i in (1, 2, 3):
        listed = listed.join(words.select(F.col("hash").alias(f"h{i}"), F.col("word").alias(f"w{i}")), f"h{i}", "left")
    total = every.groupBy("lang").agg(F.sum("n").alias("n"))
    listed = listed.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).join(F.broadcast(total), "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
