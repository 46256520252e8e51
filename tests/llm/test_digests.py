import hashlib

import numpy as np

from paperloom.llm import digests as D
from paperloom.llm.queries import op12_fingerprints
from paperloom.sources.tables import read_table
from pyspark.sql import functions as F


def brute(rows):
    """rows: (doc_id, hash, text); one byte ring at a time."""
    def digest(text):
        b = text.encode()
        counts = [0] * D.BUCKETS
        for i in range(len(b)):
            v = b[i] | b[(i + 5) % len(b)] << 8 | b[(i + 11) % len(b)] << 16
            h = (v + 1) & (2**64 - 1)
            h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
            h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
            counts[(h ^ h >> 33) >> 56] += 1
        ranked = sorted(counts)
        return [sum(c > ranked[q * 64 - 1] for q in (1, 2, 3)) for c in counts], len(b)

    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2] or ""))
    out = []
    for i, (doc_id, _, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][2] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        (a, n), (b, _) = digest(text), digest(edited)
        body = "".join(f"{a[j] << 6 | a[j + 1] << 4 | a[j + 2] << 2 | a[j + 3]:02x}" for j in range(0, 256, 4))
        cost = [[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]]
        apart = sum(cost[x][y] for x, y in zip(a, b))
        chance = sum(a.count(x) * b.count(y) * cost[x][y] for x in range(4) for y in range(4)) / 256
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), body, apart / chance if chance else 0.0))
    return out


def test_equals_brute_force_with_ties_nulls_and_empty_texts(spark):
    rows = [(5, "a"), (5, "b"), (5, "b"), (None, "no id é"), (None, None), (1, ""), (2, "xy"), (-3, "ß" * 50), (9, "The cat sat on the mat. " * 30), (8, None)]
    docs = spark.createDataFrame([(i, t, "junk") for i, t in rows], "doc_id long, text string, hash string").repartition(3)
    hashes = {r.t: r.h for r in docs.select(F.col("text").alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = D.compare_neighbours(docs).collect()
    want = brute([(i, hashes[t], t) for i, t in rows])
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint[2:]) for r in got) == sorted((str(w[0]), *w[1:4]) for w in want)
    key = {(str(w[0]), w[2], w[3]): w[4] for w in want}
    for r in got:
        body = key[str(r.doc_id), r.edited_sha256, r.fingerprint[2:]]
        assert 0 <= r.near_next <= 1 and 1 - body - D.LENGTH_SHARE - 1e-9 <= r.near_edited <= max(1 - body, 0) + 1e-9


def test_query_covers_every_document(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect()
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint[2:]) for r in op12_fingerprints(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(w[:4] for w in brute([tuple(r) for r in hashed]))


def test_edited_copies_are_nearer_than_other_documents(spark):
    rows = op12_fingerprints(spark, "/root/testdata/sf0.01").collect()
    edited, following = np.array([r.near_edited for r in rows]), np.array([r.near_next for r in rows])
    other = following[following < 1]
    above = (edited[:, None] > other[None, :]).mean()
    assert above > 0.97 and np.median(edited) > 0.6 and np.median(other) < 0.3


def test_likeness_is_bounded_and_symmetric():
    rows = D.digests(["", "", "a", "b", "a longer text, and then some", "a longer text, and then more", "x" * 9_000_000])
    assert D.likeness(rows[:1], rows[1:2])[0] == 1
    for a in range(len(rows)):
        for b in range(len(rows)):
            there, back = D.likeness(rows[a:a + 1], rows[b:b + 1])[0], D.likeness(rows[b:b + 1], rows[a:a + 1])[0]
            assert abs(there - back) < 1e-12 and 0 <= there <= 1
    assert D.likeness(rows[2:3], rows[3:4])[0] < 0.2 < D.likeness(rows[4:5], rows[5:6])[0]
    assert D.unpacked(D.packed(rows)).tolist() == rows.tolist()


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([("same",), ("same",), (None,)], "text string").withColumn("f", D.fingerprint("text"))
    got = df.withColumn("near", D.alike("f", F.lit(None).cast("string"))).collect()
    assert got[0].f == got[1].f and [r.near for r in got] == [0.0, 0.0, 1.0]
    assert D.compare_neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = D.compare_neighbours(spark.createDataFrame([(4, "alone")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"alona").hexdigest()
