import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ROWS = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (6, "x" * 60_000), (7, "X" * 60_000), (2, "abc É"), (None, "only null"), (None, "NULL too"), (9, "null too"), (10, " abc É")]


def write(folder, rows, name="part-0.parquet"):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
                             "digest": pa.array(["clash"] * len(rows)), "file": pa.array([1] * len(rows)), "norm": pa.array([None] * len(rows), pa.string())}), folder / name)
    return str(folder)


def check(got, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        kept.setdefault(r.text_sha256, []).append(r.kept)
    assert all(sum(k) == 1 for k in kept.values()) and len(kept) == len(groups)
    want = sorted(((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in g), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_edges(spark, tmp_path):
    check(exact_dedup.exact_dedup(spark, write(tmp_path / "a.parquet", ROWS)).collect(), ROWS)


def test_digest_collisions_are_split_by_the_bytes(spark, tmp_path):
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    check(exact_dedup.exact_dedup(spark, write(tmp_path / "b.parquet", ROWS * 2), digest=weak).collect(), ROWS * 2)


def test_state_goes_on_with_new_files(spark, tmp_path):
    folder, checkpoint = write(tmp_path / "c.parquet", ROWS[:6]), str(tmp_path / "state")
    before = {r.digest: r.group_size for r in exact_dedup.update_state(spark, folder, checkpoint).collect()}
    write(tmp_path / "c.parquet", ROWS[6:], "part-1.parquet")
    after = {r.digest: r.group_size for r in exact_dedup.update_state(spark, folder, checkpoint).collect()}
    assert sum(before.values()) == 6 and sum(after.values()) == len(ROWS) and set(before) <= set(after)


def test_empty_table(spark, tmp_path):
    assert exact_dedup.exact_dedup(spark, write(tmp_path / "d.parquet", [])).count() == 0
