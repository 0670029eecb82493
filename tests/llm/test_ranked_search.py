"""Ranked search against a plain scorer over all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from sluice.llm import ranked_search
from sluice.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.lower() for w in TERM.findall((text or "").encode())]


def plain_search(docs, items, k=50):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked = set(terms(text))
        scores = []
        for i, c, n in counted:
            score = 0
            for t in asked & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10 ** 9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def test_whole_table_equals_plain_scores(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(QUERIES["op12_ranked_search"](spark, SMALL)) == plain_search(docs, items)


def test_odd_rows(spark, odd_docs):
    """NULL and empty texts, repeated rows, ties, a NULL doc_id, clashing columns; items in blocks of their own."""
    items = [(1, "a B c"), (2, "lorem DOLOR, é"), (3, None), (4, ""), (4, "other a"), (None, "mit licence"), (5, "not there"), (6, "É é ß x")]
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, doc_id long, block long")
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for size in (1, 1 << 20):
        assert rows(ranked_search.ranked_search(odd_docs, asked, k=4, item_bytes=size)) == plain_search(docs, items, 4)


def test_empty_tables(spark, odd_docs):
    none = odd_docs.filter("false")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(ranked_search.ranked_search(none, items)) == []
    assert rows(ranked_search.ranked_search(odd_docs, items.filter("false"))) == []


def test_many_equal_documents(spark):
    """A third of all rows are one text: ties go by doc_id, whatever task holds them."""
    docs = [(i, "same words here" if i % 3 == 0 else f"word{i % 50} here and {'long ' * (i % 7)}") for i in range(6000)]
    items = [(1, "same words"), (2, "word7 long"), (3, "here")]
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                                      spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert rows(got) == plain_search(docs, items, 20)


def test_very_long_text(spark):
    """Texts are read in pieces that end between words, also where a word is longer than a piece."""
    docs = [(1, "alpha beta " * 300_000), (2, "x" * 3_000_000 + " alpha"), (3, "beta")]
    items = [(1, "alpha"), (2, "beta alpha")]
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == plain_search(docs, items)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_lose_nothing(seed):
    """Whatever theta: all documents at theta or above come out, with exact scores."""
    r = np.random.default_rng(seed)
    weights = r.integers(0, 13_000, 200)
    held = []
    for doc in range(1500):
        own = np.sort(r.choice(200, r.integers(1, 30), replace=False)).astype(np.int32)
        impact = r.integers(1, 1_000_000, len(own)).astype(np.int32)
        vector = (weights[own] * impact.astype(np.int64)).astype(float)
        held.append((doc, math.sqrt(vector @ vector), own.tobytes(), impact.tobytes(), dict(zip(own.tolist(), impact.tolist()))))
    held.sort(key=lambda h: -h[1])
    batch = ranked_search._Batch(*map(list, zip(*[h[:4] for h in held])), weights)
    for _ in range(20):
        asked = np.sort(r.choice(200, r.integers(1, 40), replace=False))
        want = np.array([sum(int(weights[t]) * h[4].get(t, 0) for t in asked.tolist()) for h in held])
        for theta in (0, int(np.quantile(want, 0.5)), int(np.quantile(want, 0.99)), int(want.max()), int(want.max()) + 1):
            at, scores = batch.search(asked, math.sqrt(len(asked)) * ranked_search.SLACK, theta)
            good = np.flatnonzero(want >= max(theta, 1))
            assert at.tolist() == good.tolist() and scores.tolist() == want[good].tolist()
