"""N-gram Jaccard join by vertical partitioning.

The distinct shingles of a document are cut along one global order into fragments; fragments are compared on their own
and the partial overlaps are summed per pair.  Two documents link when overlap / union reaches the threshold.

1. ``prefix_rows``: the global order is the shingle hash here.  Linked documents share shingles within a prefix of
   both (prefix principle), so only prefixes travel, fragment by fragment, packed per batch.  A shingle that occurs
   twice in a batch travels once, whatever its frequency.  Documents whose prefix holds too few shared shingles for
   any partner are settled: they link with nothing.
2. Equal sets are one class; one representative of each class that is left goes on with its fragments.
3. The representatives' shingles are ordered by document frequency, and rare-first prefixes are compared.  Every
   prefix shingle first proposes one pair for each of its documents, with the first document that it can follow, and
   the best proposal of each document is verified: a group of copies falls together without its pairs being listed.
   A second round has another document, drawn by hash, lead each list, for documents that are still apart from it.
   Then every pair is verified that lies in two components, has a common prefix shingle, has enough shingles from there
   on for the overlap that its sizes ask for, and whose parity bits don't differ in more places than the sets may.  One
   join applies all these bounds, so its rows are candidates, once for each prefix shingle that a pair shares.
   That is enough for the components; links within one may be missing.  With every_link, instead of all this, every
   pair is verified that meets the same bounds, whatever its component: the links are the whole join.
4. Verification joins a pair's fragments, counts each overlap, and sums.

Rows: null or empty texts and texts without words have no shingles and link with nothing; a null doc_id is returned
with its count, links with nothing and has no component.  Repeated rows are copies.  Rows that share a doc_id but not
the text are separate nodes of the same name.  Other columns are not read.  Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm._shared import ship_package, stored
from paperloom.llm.components import components

FRAGMENTS = 4  # of each representative's set in verification
PARITY_WORDS = 4  # of 64 bits, for each fragment
SLACK = 20  # a prefix is longer by 1/SLACK of the set, and must share that much more


class Linked(NamedTuple):
    rows: DataFrame  # doc_id, n_shingles, component_id; with every_link also n_links, copies included
    links: DataFrame  # a, b, overlap, n_a, n_b: verified pairs of classes (node); with every_link all, else enough for the components
    members: DataFrame  # doc_id, node: each row that can link, and its class of equal sets; rows of one class link as well


def _least(n, percent):
    """Shingles that a set of n shares with any linked set at least; also the size of its smallest partner."""
    return -(-n * percent // 100)


def _shared_at_least(n, percent):
    """Of these, those within both prefixes, for the smallest partner."""
    return _least(n, percent) // SLACK + 1


def _prefix(n, percent):
    return np.minimum(n - _least(n, percent) + n // SLACK + 1, n)


def _repeated(ranked: np.ndarray) -> np.ndarray:
    """Marks the values of a sorted array that occur more than once."""
    out = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _scan(k: int, percent: int, fragments: int):
    """Each batch of texts -> its documents' counts and digests, and its prefixes by fragment."""
    schema = pa.schema([("fragment", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("often", pa.binary()),
                        ("meta", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            numbers = np.asarray(ids.fill_null(0)).astype(np.int64)
            hashes, docs, counts, digests = [], [], [], []
            for block in W.blocks(batch.column("text")):
                sets, starts = W.shingles(block, k)
                n = np.diff(starts)
                counts.append(n)
                digests += [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None
                            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                rows = np.arange(block.row, block.row + len(n))
                take = np.where(known[rows], _prefix(n, percent), 0)
                at = np.arange(take.sum()) + np.repeat(starts[:-1] - np.cumsum(take) + take, take)
                hashes.append(sets[at])
                docs.append(np.repeat(numbers[rows], take))
            if not counts:
                continue
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            twice = _repeated(h)
            local, times = np.unique(d[twice], return_counts=True)
            often = np.unique(h[twice])
            h, d = h[~twice], d[~twice]
            cut = np.arange(1, fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments)
            a, b = np.concatenate([[0], np.searchsorted(h, cut), [len(h)]]), np.concatenate([[0], np.searchsorted(often, cut), [len(often)]])
            n = np.concatenate(counts).astype(np.int32)
            meta = pa.StructArray.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(digests, pa.binary())], ["doc_id", "n", "digest"])
            counted = pa.StructArray.from_arrays([pa.array(local), pa.array(times.astype(np.int32)), pa.nulls(len(local), pa.binary())], ["doc_id", "n", "digest"])
            # the documents of a batch, and their shingles that are shared within it, go along with two fragments
            first = int(numbers[0]) % fragments
            out = {"fragment": [], "hashes": [], "docs": [], "often": []}
            metas = []
            for f in range(fragments):
                if a[f + 1] > a[f] or b[f + 1] > b[f] or f == first:
                    out["fragment"].append(f)
                    out["hashes"].append(W.planes(h[a[f]:a[f + 1]]))
                    out["docs"].append(W.planes(d[a[f]:a[f + 1]]))
                    out["often"].append(W.planes(often[b[f]:b[f + 1]]))
                    metas.append(len(meta) if f == first else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *metas]).astype(np.int32)), meta)
            yield pa.RecordBatch.from_arrays([pa.array(out["fragment"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("hashes", "docs", "often")), lists], schema=schema)
            lists = pa.ListArray.from_arrays(pa.array([0, len(counted)], pa.int32()), counted)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - first], pa.int32()), *[pa.array([b""], pa.binary())] * 3, lists], schema=schema)

    return run


def _fragment_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches' part of one fragment -> how many of its shingles each document shares; documents go through."""
    table = pa.Table.from_batches(list(batches))
    hashes = np.concatenate([W.unplanes(x.as_py(), np.uint64) for x in table["hashes"]])
    docs = np.concatenate([W.unplanes(x.as_py(), np.int64) for x in table["docs"]])
    often = np.concatenate([W.unplanes(x.as_py(), np.uint64) for x in table["often"]])
    every = np.concatenate([hashes, often, often])  # counts as two
    order = np.argsort(every, kind="stable")
    shared = np.empty(len(every), bool)
    shared[order] = _repeated(every[order])
    found, times = np.unique(docs[shared[:len(docs)]], return_counts=True)
    meta = table["meta"].combine_chunks().flatten()
    counted = key[0].as_py() < 0
    parts = []
    if len(meta):
        n = meta.field("n")
        parts.append([meta.field("doc_id"), pa.nulls(len(n), pa.int32()) if counted else n, meta.field("digest"), n if counted else pa.nulls(len(n), pa.int32())])
    parts.append([pa.array(found), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary()), pa.array(times.astype(np.int32))])
    for p in parts:
        yield pa.RecordBatch.from_arrays(p, ["doc_id", "n", "digest", "shared"])


def _parity(part: np.ndarray) -> list[int]:
    """A bit for each residue of the shingles' hashes: whether it occurs an odd number of times."""
    odd = np.bincount((part % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(k: int, fragments: int):
    """Texts of representatives -> their sets by fragment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.arange(1, fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments)
        for batch in batches:
            nodes, wanted = np.asarray(batch.column("node")), batch.column("digest")
            for block in W.blocks(batch.column("text")):
                sets, starts = W.shingles(block, k)
                out = {"node": [], "n": [], "fragment": [], "parity": []}
                values, lengths = [], []
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    s, row = sets[a:b], block.row + i
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != wanted[row].as_py():
                        continue  # another text under the same doc_id
                    for f, part in enumerate(np.split(s, np.searchsorted(s, cut))):
                        if len(part):
                            out["node"].append(int(nodes[row])), out["n"].append(b - a), out["fragment"].append(f), out["parity"].append(_parity(part))
                            values.append(part.view(np.int64))
                            lengths.append(len(part))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["fragment"], pa.int32()), lists, pa.array(out["parity"], pa.list_(pa.int64()))], ["node", "n", "fragment", "part", "parity"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) that link: partial overlaps by fragment, summed."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("part").alias("part_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("part").alias("part_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("partial"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("overlap"))
    return total.where(F.col("overlap") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(hash, node, n, rest) of the shingles in each representative's prefix by document frequency that others have
    too; rest: how many of its shingles stand from there on."""
    rows = sets.select("node", "n", F.explode("part").alias("hash"))
    df = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = rows.join(df, "hash").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("ranked"))
    length = F.col("n") - F.expr(f"cast(ceil(n * {percent} / 100.0) as int)") + 1  # shingles without company come first
    head = F.greatest(length - (F.col("n") - F.size("ranked")), F.lit(0))
    ranked = own.select("node", "n", F.size("ranked").alias("shared"), F.posexplode(F.slice("ranked", 1, head)["hash"]).alias("at", "hash"))
    return ranked.select("hash", "node", "n", (F.col("shared") - F.col("at")).alias("rest"))


def _fit(n_1: str, rest_1: str, n_2: str, rest_2: str, percent: int) -> Column:
    """Whether two sets can link whose first common shingle leaves these rests: the overlap is no larger than either.
    As percent of the union it must be enough, so the smaller set of a pair has ``_leads``."""
    return F.least(rest_1, rest_2) * (100 + percent) >= percent * (F.col(n_1) + F.col(n_2))


def _parities(sets: DataFrame) -> DataFrame:
    """(node, parity) of whole sets."""
    none = F.array(*[F.lit(0).cast("long")] * PARITY_WORDS)
    own = [F.coalesce(F.first(F.when(F.col("fragment") == f, F.col("parity")), ignorenulls=True), none) for f in range(FRAGMENTS)]
    return sets.groupBy("node").agg(F.concat(*own).alias("parity"))


def _near(percent: int) -> Column:
    """Whether parities leave room for a link: they differ in no more bits than the sets differ in shingles."""
    apart = F.aggregate(F.zip_with("parity", "parity_2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return apart * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("n_2"))


def _leads(percent: int) -> Column:
    """Whether a set can be the smaller one of a pair, or as large as the other."""
    return F.col("rest") * (100 + percent) >= 2 * percent * F.col("n")


def _other_leaders(prefix: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document with the leaders of its lists that lie in other components; a pair for a list entry at most."""
    placed = prefix.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    draw = F.struct(F.xxhash64("node", "hash").alias("draw"), "node", "n", "rest", "component")
    leader = placed.where(_leads(percent)).groupBy("hash").agg(F.min(draw).alias("l")).select(
        "hash", F.col("l.node").alias("b"), F.col("l.n").alias("n_2"), F.col("l.rest").alias("rest_2"), F.col("l.component").alias("other"))
    pairs = placed.join(leader, "hash").where("component <> other").where(_fit("n", "rest", "n_2", "rest_2", percent))
    pairs = stored(pairs.select(F.col("node").alias("a"), "b", "n", "n_2").distinct(), "led-pairs")
    parity = _parities(sets)
    pairs = pairs.join(parity.withColumnRenamed("node", "a"), "a").join(parity.select(F.col("node").alias("b"), F.col("parity").alias("parity_2")), "b")
    return pairs.where(_near(percent)).select("a", "b").distinct()


def _every_pair(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all that have a common prefix shingle and pass the positional and parity bounds."""
    placed = stored(prefix.join(_parities(sets), "node"), "placed")
    small = placed.where(_leads(percent)).select("hash", F.col("node").alias("b"), F.col("n").alias("n_2"), F.col("rest").alias("rest_2"), F.col("parity").alias("parity_2"))
    pairs = placed.join(small, "hash").where("n_2 < n or n_2 = n and b < node")
    pairs = pairs.where(_fit("n", "rest", "n_2", "rest_2", percent)).where(_near(percent))
    return stored(pairs.select(F.col("node").alias("a"), "b").distinct(), "pairs")


def _some_links(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified pairs that have the components of all links."""
    small = prefix.where(_leads(percent))
    leader = small.groupBy("hash").agg(F.min(F.struct("node", "n", "rest")).alias("l")).select("hash", F.col("l.node").alias("other"), F.col("l.n").alias("n_2"), F.col("l.rest").alias("rest_2"))
    proposed = prefix.join(leader, "hash").where(_fit("n", "rest", "n_2", "rest_2", percent)).where("node <> other")
    proposed = proposed.groupBy("node", "other").agg(F.count(F.lit(1)).alias("c"))
    best = proposed.groupBy("node").agg(F.max(F.struct("c", "other")).alias("best")).select(F.col("best.other").alias("a"), F.col("node").alias("b"))
    first = stored(verify(best, sets, percent), "links")
    grouped = components(first.select("a", "b"))

    # a second round, for what the first left apart: on each list another document leads, drawn by hash
    first = first.union(stored(verify(_other_leaders(prefix, grouped, sets, percent), sets, percent), "links"))
    grouped = components(first.select("a", "b"))

    placed = prefix.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(_leads(percent)).alias("some")).where("x < y and some").select("hash")
    placed = stored(placed.join(mixed, "hash", "left_semi").join(_parities(sets), "node"), "cross")
    small = placed.where(_leads(percent)).select("hash", F.col("node").alias("b"), F.col("component").alias("other"), F.col("n").alias("n_2"), F.col("rest").alias("rest_2"), F.col("parity").alias("parity_2"))
    # all bounds are part of the join, so that it makes no rows but pairs that only a verification can decide
    cross = placed.join(small, "hash").where("component <> other").where("n_2 < n or n_2 = n and b < node").where(_fit("n", "rest", "n_2", "rest_2", percent))
    cross = stored(cross.where(_near(percent)).select(F.col("node").alias("a"), "b").distinct(), "cross-pairs")
    return first.union(stored(verify(cross, sets, percent), "links"))


def _link_counts(meta: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, n_links): for a row of each class, the rows of its own class but itself and of the linked classes."""
    sizes = stored(meta.where("doc_id is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("size")).join(classes, "digest").select("digest", "node", "size"), "class-sizes")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("others"))
    return sizes.join(others, "node", "left").select("digest", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def jaccard_join(docs: DataFrame, text: str = "text", k: int = 5, percent: int = 75, every_link: bool = False) -> Linked:
    """Documents whose distinct k-word shingles link, as components; with every_link all links and their number for
    each row, else only as many links as the components need."""
    spark = docs.sparkSession
    ship_package(spark)
    fragments = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scanned = docs.mapInArrow(_scan(k, percent, fragments), "fragment int, hashes binary, docs binary, often binary, meta array<struct<doc_id:bigint,n:int,digest:binary>>")
    counts = stored(scanned.groupBy("fragment").applyInArrow(_fragment_counts, "doc_id long, n int, digest binary, shared int"), "prefixes")
    meta = counts.where("n is not null").select("doc_id", "n", "digest")
    shared = counts.where("shared is not null").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    enough = F.expr(f"shared >= floor(ceil(n * {percent} / 100.0) / {SLACK}) + 1")
    left = meta.join(shared, "doc_id").where(enough)
    classes = left.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    texts = docs.join(classes, "doc_id").select("node", "digest", "text").dropDuplicates()
    sets = stored(texts.mapInArrow(_sets(k, FRAGMENTS), "node long, n int, fragment int, part array<bigint>, parity array<bigint>"), "sets")

    prefix = stored(_rare_first(sets, percent), "rare-first")
    links = stored(verify(_every_pair(prefix, sets, percent), sets, percent), "links") if every_link else _some_links(prefix, sets, percent)

    final = components(links.select("a", "b"))
    named = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least, "component").select("digest", "component_id"), "components")
    rows_of = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")]
    rows = meta.join(named, "digest", "left").select(*rows_of)
    members = meta.where("doc_id is not null").join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    if every_link:
        counts = _link_counts(meta, classes, links).withColumnRenamed("digest", "d")
        rows = meta.join(named, "digest", "left").join(counts, F.col("digest") == F.col("d"), "left").select(
            *rows_of, F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return Linked(rows, links, members)


def document_pairs(linked: Linked) -> DataFrame:
    """(x, y): the linked rows of different classes by doc_id, each pair once.  Only with every_link these are all."""
    left, right = linked.members.select(F.col("doc_id").alias("x"), F.col("node").alias("a")), linked.members.select(F.col("doc_id").alias("y"), F.col("node").alias("b"))
    return linked.links.join(left, "a").join(right, "b").select("x", "y")
