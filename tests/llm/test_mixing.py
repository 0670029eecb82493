import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing


def level(sizes):
    """Weighted shares, capped and reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(docs, block):
    rows = [r.asDict() for r in mixing.mixed(docs, block=block).collect()]
    sizes = defaultdict(int)
    words = [(r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in docs.collect()]
    for _, s, n in words:
        sizes[s] += n
    assert sorted(words, key=str) == sorted([(r["doc_id"], r["source"], r["size"]) for r in rows], key=str)
    wanted = level(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - wanted[s]) <= 1
    return rows


def test_targets_and_taken(odd_docs, small_docs):
    check(odd_docs, 7)
    first = check(small_docs, 64)
    assert sorted(map(str, first)) == sorted(map(str, check(small_docs, 64)))
    assert mixing.mixed(odd_docs.limit(0)).count() == 0


def test_schedule_is_a_permutation_that_keeps_shares(spark):
    need = mixing.needs(spark.createDataFrame([("a", 900, 1500.0), ("b", 500, 300.0), ("c", 10, 30.0)], "source string, source_size long, target double"), 10)
    rows = sorted(mixing.schedule(need, 10).collect(), key=lambda r: r.slot)
    assert len({r.slot for r in rows}) == len(rows)
    for source, quota, blocks in (("a", 1500, 90), ("b", 300, 50), ("c", 30, 1)):
        own = [r for r in rows if r.source == source]
        assert [r.rank for r in own] == list(range(len(own))) and sum(r.words for r in own) == quota
        for turn in {r.turn for r in own}:
            assert len({r.block for r in own if r.turn == turn}) == sum(r.turn == turn for r in own)
        assert {r.block for r in own if r.turn == 0} <= set(range(blocks))
    share = np.cumsum([r.source == "a" for r in rows]) / np.arange(1, len(rows) + 1)
    assert abs(share[40:] - 150 / len(rows)).max() < 0.06


def test_ranks_by_bit_arithmetic():
    bits = 7
    rev = mixing.reversed_bits(np.arange(128), bits)
    for end in (0, 1, 5, 64, 100, 127, 128):
        for when in (0, 1, 33, 127):
            assert mixing.visited_before(np.array([end]), np.array([when]), bits)[0] == (rev[:end] < when).sum()


def test_repeats(odd_docs):
    out = mixing.repeat_to_targets(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.groupBy("doc_id", "source").agg(F.count("*").alias("n")).filter("n > 6").count() == 0
