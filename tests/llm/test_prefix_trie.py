import hashlib
import zlib

import numpy as np
import pytest

from paperloom.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, shared):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    members, ends, children = {}, {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
            if d:
                children.setdefault(path[:d - 1], set()).add(path[:d])
        ends.setdefault(path, []).append(c)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        add = (len(who) - 1) * len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += add
    nodes = [(min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, ())), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, who in members.items()]
    return sorted(nodes, key=str) if built else []


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, hi string, depth int")


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def cases(seed, n=400):
    rng = np.random.default_rng(seed)
    words = ["one", "two\tthree", "", None, "é ü", "a\x0bb c"]
    rows = []
    for c in rng.integers(0, 90, n).tolist():
        rows.append((c if rng.random() > 0.03 else None, int(rng.integers(0, 4)) if rng.random() > 0.1 else None, ["user", "assistant", None][rng.integers(3)], words[rng.integers(len(words))]))
    return rows + rows[:20] + [(200, t, "user", f"turn {t % 7}") for t in range(60)] + [(210, t, "user", f"turn {t % 7}") for t in range(50)]


@pytest.mark.parametrize("shared", [True, False])
def test_equals_brute_force(spark, shared):
    rows = cases(1)
    df = frame(spark, rows).repartition(5)
    assert got(T.opened_trie(df) if shared else T.conversation_trie(df)) == brute(rows, shared)


def test_long_conversations_span_tasks_blocks_and_shards(spark, monkeypatch):
    """Paths cut into blocks of 8 and shards of some 50 rows, ends into ranges of 4 ids."""
    rows = cases(2) + [(c, 0, "user", "same start") for c in range(300, 360)]
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "SHARD_ROWS", 50)
    monkeypatch.setattr(T, "ENDS_RANGE", 2)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(T.opened_trie(frame(spark, rows))) == brute(rows, True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    keys = rng.integers(-2**63, 2**63 - 1, (3, 50_000))
    keys[0] = rng.integers(0, 9, 50_000)
    table = T.SlotTable(*keys)
    assert sorted(table.find(*keys).tolist()) == list(range(50_000))
    assert (table.find(keys[0] + 1, keys[1], keys[2]) == -1).all() and (table.find(keys[0], keys[1], keys[2] ^ 1) == -1).all()
    empty = T.SlotTable(*np.zeros((3, 0), np.int64))
    assert empty.find(*keys[:, :2]).tolist() == [-1, -1]


def test_no_conversation_has_no_root_and_turnless_ones_end_there(spark):
    assert got(T.opened_trie(frame(spark, []))) == []
    assert got(T.opened_trie(frame(spark, [(None, 0, "user", "nobody's")]))) == []
    short = [(c, 0, "user", "hello") for c in range(21, 40)]  # nobody lends: those that skip their only turn are turnless
    assert got(T.opened_trie(frame(spark, short))) == brute(short, True)
