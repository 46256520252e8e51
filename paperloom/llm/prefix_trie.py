"""Prefix trie of conversations over a minimal-perfect-hash node table.

A node is a distinct sequence of first turns (role, text); the root has none.  For every node the operator tells how
many conversations begin with it, how many nodes continue it, how many leaves lie below it, how many words of prompt a
cache of prefixes saves there and below, and which conversations end there.

1. ``ordered_turns``: turns are dealt out by ranges of (conv_id, turn, role, text), so a conversation of any length may
   span tasks; each task walks its range and keeps the digest and number of words of a turn, not its text.
2. ``prefixes``: a prefix's digest is the XOR of its turns' digests, each salted with its position (128 bits), so it
   comes from running XORs in blocks of BLOCK turns, and the parent's digest from one more XOR.
3. Distinct digests are the nodes; each belongs to its smallest member.  Counts combine before the shuffle.
4. Subtree sums: the blocks of the owners' paths are dealt to shards of about SHARD_ROWS rows.  A shard enumerates its
   distinct digests, gives each a slot by a minimal perfect hash (every lookup is checked against the digest in the
   slot), scatters what its nodes add into flat arrays and adds each depth into its parents' slots, deepest first.
   What lies in later blocks of a path enters with the block's last row.  Partial sums of the shards add up per node.

Rows: rows without conv_id belong to no conversation and are left out.  Null roles and texts are empty; a null turn
comes first; rows of one turn come by role, then text, repeated rows all count.  Long texts are read whole.  Without any
conversation there is no node, not even the root.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm._shared import ship_package, stored

BLOCK = 4096  # turns of a path that go to one shard together
SHARD_ROWS = 200_000
ENDS_RANGE = 16  # bits of conv_id within a piece of a node's list of ends
KEY = ["depth", "hi", "lo"]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, conv, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        out = {"conv_id": [], "part": [], "at": [], "hi": [], "lo": [], "words": []}
        for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
            conv, at = c, (at + 1 if c == conv else 0)
            role, text = role.encode(), text.encode()
            digest = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
            values = (c, part, at, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), len(text.split()))
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in out]))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, at, hi, lo, words): each turn's place in its conversation from 0, digest of role and text, and words."""
    ship_package(turns.sparkSession)
    none = F.lit("")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    dealt = rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    walked = stored(dealt.mapInArrow(_walk, "conv_id long, part long, at long, hi long, lo long, words long"), "turns")
    parts = walked.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))  # one row for each task that a conversation spans
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("conv_id", "part", F.sum("n").over(before).alias("offset")).where("offset > 0")
    placed = walked.join(offset, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("at"), "hi", "lo", "words")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def shared_openings(turns: DataFrame, every: int = 20, opening: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the conversation c - c % every, and their lengths.

    h is crc32(decimal c) % opening; a shorter or absent lender gives what it has, and c's own turns follow from its
    h-th on.  A lender's few first turns go to at most ``every`` conversations."""
    n = stored(lengths(turns), "lengths")
    lent = n.select(F.col("conv_id").alias("lender"), F.col("length").alias("lender_length"))
    plan = n.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % opening, "lender": F.col("conv_id") - F.col("conv_id") % every})
    plan = plan.join(lent, "lender", "left").withColumn("lent", F.least("h", F.coalesce("lender_length", F.lit(0))))
    plan = stored(plan.select("conv_id", "lender", "h", "lent", (F.col("lent") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "openings")
    own = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "hi", "lo", "words")
    first = turns.where(F.col("at") < opening - 1).withColumnRenamed("conv_id", "lender")
    borrowed = plan.where("lent > 0").join(first, "lender").where("at < lent").select("conv_id", "at", "hi", "lo", "words")
    return own.union(borrowed), plan.select("conv_id", "length")


def _xor(a: str, b: str):
    return F.expr(f"{a} ^ {b}")


def prefixes(turns: DataFrame, length: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, up_hi, up_lo, words, last): every prefix of every conversation and its parent's digest;
    the root is depth 0 with digest 0.  ``length`` has all conversations, also those without turns."""
    rows = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "hi", "lo", "words")
    rows = rows.select("conv_id", "depth", "words", F.expr(f"depth div {BLOCK}").alias("block"), F.xxhash64("depth", "hi", "lo").alias("own_hi"), F.xxhash64("lo", "hi", "depth").alias("own_lo"))
    whole = rows.groupBy("conv_id", "block").agg(F.bit_xor("own_hi").alias("hi"), F.bit_xor("own_lo").alias("lo"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    carry = whole.select("conv_id", "block", F.bit_xor("hi").over(before).alias("c_hi"), F.bit_xor("lo").over(before).alias("c_lo")).where("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # BLOCK rows at most
    run = rows.withColumns({"r_hi": F.bit_xor("own_hi").over(within), "r_lo": F.bit_xor("own_lo").over(within)}).join(carry, ["conv_id", "block"], "left")
    run = run.withColumns({"hi": F.expr("r_hi ^ coalesce(c_hi, 0L)"), "lo": F.expr("r_lo ^ coalesce(c_lo, 0L)")}).join(length, "conv_id")
    deep = run.select("conv_id", "depth", "hi", "lo", _xor("hi", "own_hi").alias("up_hi"), _xor("lo", "own_lo").alias("up_lo"), "words", (F.col("depth") == F.col("length")).alias("last"))
    zero = F.lit(0).cast("long")
    root = length.select("conv_id", zero, zero, zero, zero, zero, zero, (F.col("length") == 0))
    return deep.union(root)


class SlotTable:
    """A minimal perfect hash over distinct (depth, hi, lo): keys that are alone on a position of a level keep it, the
    others go on to the next level; a key's slot is the number of kept positions before its own."""

    def __init__(self, depth: np.ndarray, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, placed, slot = np.arange(len(hi)), 0, np.empty(len(hi), np.int64)
        while len(left):
            level = len(self.levels)
            at = self._position(level, 2 * len(left), depth[left], hi[left], lo[left])
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            number = placed + np.cumsum(alone) - 1
            self.levels.append((2 * len(left), alone, number))
            slot[left[alone[at]]] = number[at[alone[at]]]
            placed += int(alone.sum())
            left = left[~alone[at]]
        self.depth, self.hi, self.lo = (np.empty(len(hi), np.int64) for _ in range(3))
        self.depth[slot], self.hi[slot], self.lo[slot] = depth, hi, lo

    @staticmethod
    def _position(level: int, size: int, depth: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        h = W.mix(lo.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        return (W.mix(W.mix(h ^ hi.view(np.uint64)) + depth.astype(np.uint64)) % np.uint64(size)).astype(np.int64)

    def find(self, depth: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that the table doesn't hold: the slot's own key decides."""
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (size, alone, number) in enumerate(self.levels):
            at = self._position(level, size, depth[left], hi[left], lo[left])
            kept = alone[at]
            out[left[kept]] = number[at[kept]]
            left = left[~kept]
        held = out >= 0
        held[held] = (self.depth[out[held]] == depth[held]) & (self.hi[out[held]] == hi[held]) & (self.lo[out[held]] == lo[held])
        return np.where(held, out, -1)


def _accumulate(block: int):
    """Rows of a shard -> what each of its nodes sums up to within the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        depth, hi, lo, up_hi, up_lo, leaves, saved = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("depth", "hi", "lo", "up_hi", "up_lo", "leaves", "saved"))
        order = np.lexsort((lo, hi, depth))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(depth[order]) != 0) | (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)
        distinct = order[new]
        slots = SlotTable(depth[distinct], hi[distinct], lo[distinct])
        own = slots.find(depth, hi, lo)
        parent = np.full(len(distinct), -1, np.int64)
        parent[own] = np.where(depth % block == 0, -1, slots.find(depth - 1, up_hi, up_lo))
        if (own < 0).any() or ((parent < 0) != (slots.depth % block == 0)).any():
            raise ValueError("a prefix has no slot, or its parent has none")
        below = np.zeros((len(distinct), 2), np.int64)
        np.add.at(below, own, np.stack([leaves, saved], axis=1))
        deepest_first = np.argsort(-slots.depth, kind="stable")
        for nodes in np.split(deepest_first, np.flatnonzero(np.diff(slots.depth[deepest_first])) + 1):
            if slots.depth[nodes[0]] % block:
                np.add.at(below, parent[nodes], below[nodes])
        sums = [pa.array(np.ascontiguousarray(x)) for x in (slots.depth, slots.hi, slots.lo, below[:, 0], below[:, 1])]
        yield pa.RecordBatch.from_arrays(sums, [*KEY, "leaves", "saved"])

    return run


def _subtree_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, hi, lo, leaves, saved) of ``nodes(depth, hi, lo, conv_id, leaf, saves)`` and all below them."""
    owners = paths.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi")
    adds = nodes.select(*KEY, "conv_id", F.col("leaf").cast("long").alias("leaves"), F.col("saves").alias("saved"))
    rows = owners.join(adds, [*KEY, "conv_id"], "left").na.fill(0, ["leaves", "saved"])
    rows = stored(rows.select("conv_id", *KEY, "up_hi", "up_lo", "leaves", "saved"), "paths")
    # the later blocks of a path count with the last row of each block before them
    later = rows.where(F.col("depth") >= BLOCK).groupBy("conv_id", F.expr(f"depth div {BLOCK}").alias("block")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    later = later.select("conv_id", (F.col("block") * BLOCK - 1).alias("depth"), F.sum("l").over(down).alias("l"), F.sum("s").over(down).alias("s"))
    rows = rows.join(later, ["conv_id", "depth"], "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("conv_id", F.expr(f"depth div {BLOCK}")), F.lit(shards)))
    partial = rows.select("shard", *KEY, "up_hi", "up_lo", "leaves", "saved").groupBy("shard").applyInArrow(_accumulate(BLOCK), "depth long, hi long, lo long, leaves long, saved long")
    return partial.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pieces of each node's list of ends -> its SHA-256, piece by piece."""
    node, state = None, None
    for b in batches:
        out = []
        for d, h, lo, piece in zip(*(b.column(c).to_pylist() for c in (*KEY, "piece")), strict=True):
            if (d, h, lo) == node:
                state.update(b"," + piece.encode())
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = (d, h, lo), hashlib.sha256(piece.encode())
        yield _digest_batch(out)
    if node is not None:
        yield _digest_batch([(*node, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """SHA-256 of the decimal ids of the conversations that end at a node, ascending, joined by commas.  Ids are sorted
    in ranges of 2^ENDS_RANGE; a node's ranges then pass one task in order, which holds one at a time."""
    pieces = paths.where("last").groupBy(*KEY, F.shiftright("conv_id", ENDS_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*KEY, "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("piece"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "range").mapInArrow(_joined_digests, "depth long, hi long, lo long, ends_sha256 string")


def trie(turns: DataFrame, length: DataFrame) -> DataFrame:
    """One row for each node: depth, hi, lo (its digest), conv_id (smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stored(prefixes(turns, length), "prefixes")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"))
    nodes = stored(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").na.fill(0, ["n_children"]), "node-children")
    sums = _subtree_sums(paths, nodes.select(*KEY, "conv_id", (F.col("n_children") == 0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saves")))
    up = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, KEY).join(_ends(paths), KEY, "left").join(up, ["depth", "up_hi", "up_lo"], "left")
    return full.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of ``turns(conv_id, turn, role, text)`` as they are."""
    ordered = stored(ordered_turns(turns), "ordered")
    return trie(ordered, lengths(ordered))


def opened_trie(turns: DataFrame) -> DataFrame:
    """The trie after conversations took over their lenders' openings."""
    return trie(*shared_openings(stored(ordered_turns(turns), "ordered")))
