"""The prefix trie against a plain trie of Python dicts."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import prefix_trie
from sluice.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_trie(rows, every=1, heads=0):
    """Contract rows for (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        rest = -(-c % every) if c < 0 else c % every
        built[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own_saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = own_saved + sum(saved[k] for k in children[path])
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, df, **how):
    tries = prefix_trie.local_tries(df, **how)
    hashed = prefix_trie.list_digests(prefix_trie.end_lists(tries)).withColumnRenamed("node", "_of")
    out = prefix_trie.trie_nodes(tries).join(hashed, F.col("node") == F.col("_of"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())))
    return sorted([tuple(r) for r in out.collect()], key=str)


DDL = "conv_id long, turn long, role string, text string, node string, parent string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DDL)


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.read.parquet(f"{SMALL}/conversations.parquet")


def test_whole_table_equals_a_plain_trie(spark, conversations):
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    want = plain_trie(rows, 100, 6)
    assert sorted([tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SMALL).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()], key=str) == want
    assert "op11_prefix_trie" in ORACLES
    assert got(spark, conversations, width=7) == plain_trie(rows)


def test_odd_rows(spark):
    """NULLs, repeated and tied rows, negative ids, absent bases, empty turns, clashing columns; every block holds two conversations."""
    rows = [(0, 0, "user", "a"), (0, 1, None, "é b"), (0, None, "user", None), (-5, 0, "user", "a"), (-3, 0, "user", "a"), (-105, 1, "u", "q"),
            (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "b"), (None, 0, "user", "a"), (205, 0, "user", "z"), (311, 2, "", ""),
            (312, 0, "", ""), (312, 3, "", ""), (313, 0, None, None), (300, 1, "", "")]
    rows += [(c, t, "user", f"turn {t}") for c in range(400, 440) for t in range(c % 5 + 1)]
    for every, heads in ((100, 6), (1, 0)):
        assert got(spark, frame(spark, rows), every=every, heads=heads, width=2) == plain_trie(rows, every, heads)


def test_no_conversations(spark):
    assert got(spark, frame(spark, []), every=100, heads=6) == []
    assert got(spark, frame(spark, [(None, 1, "user", "x")])) == []


def test_long_conversations_are_streamed(spark):
    """Conversations that leave the bitmaps in the middle, share their tails, end at each other's depths."""
    rows = [(c, t, "user", f"{t % 3}") for c, n in ((1, 300), (2, 300), (3, 120), (4, 20), (5, 21), (6, 19)) for t in range(n)]
    rows += [(7, t, "user", "other" if t == 50 else f"{t % 3}") for t in range(90)]
    assert got(spark, frame(spark, rows), long_turns=20) == plain_trie(rows)


def test_one_conversation_many_times(spark):
    """A third of all conversations are equal; their list spans many blocks."""
    rows = [(c, t, "user", "same" if c % 3 == 0 else str(c)) for c in range(900) for t in range(3)]
    assert got(spark, frame(spark, rows).repartition(6), width=16) == plain_trie(rows)


def test_hot_parents_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEAVY_CHILDREN", 3)
    rows = [(c, t, "user", "start" if t == 0 and c % 2 else f"{c} {t}") for c in range(60) for t in range(3)]
    assert got(spark, frame(spark, rows)) == plain_trie(rows)
