"""Segments against an exhaustive search, fits against drawn data, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from sluice.llm import toxicity
from sluice.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def plain_segments(scores):
    """The best segment (first token of its best start), then the same on both sides of it."""
    found = []

    def split(a, b):
        totals = np.concatenate([[0.0], np.cumsum(scores[a:b])])
        best = max(((totals[j] - totals[i], -(j - i), -i) for i in range(len(totals)) for j in range(i + 1, len(totals))), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return
        i, size = -best[2], -best[1]
        split(a, a + i)
        found.append((a + i, a + i + size))
        split(a + i + size, b)

    split(0, len(scores))
    return found


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_the_exhaustive_search(seed):
    r = np.random.default_rng(seed)
    scores = r.choice([-3.0, -1.25, -0.5, 0.75, 1.5, 2.0], r.integers(0, 40)) + r.random() / 7
    whole = toxicity.Segments()
    whole.feed(scores)
    parts = toxicity.Segments()
    for part in np.array_split(scores, 5):
        parts.feed(part)
    assert list(zip(whole.start, whole.end)) == plain_segments(scores)
    assert (whole.start, whole.end, parts.tokens) == (parts.start, parts.end, len(scores))
    assert np.allclose(whole.scores(), [scores[a:b].sum() for a, b in zip(whole.start, whole.end)])


def test_many_candidates_take_linear_time():
    """Falling totals before each candidate, the case that a plain search from the right makes quadratic."""
    import time

    def seconds(n):
        scores = np.tile([1.0, -1.5], n)
        start = time.perf_counter()
        found = toxicity.Segments()
        found.feed(scores)
        assert len(found.start) == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 60 * seconds(10_000) + 1


def test_extreme_values_are_recovered():
    r = np.random.default_rng(5)
    tokens = r.integers(50, 5000, 20_000).astype(float)
    best = (np.log(0.07 * tokens) - np.log(-np.log(r.random(20_000)))) / 1.3
    rate, scale = toxicity.fit_extremes(best, tokens)
    assert abs(rate - 1.3) < 0.05 and abs(scale / 0.07 - 1) < 0.15


def test_stem_decides_on_unseen_words():
    words = np.array([b"badword", b"\x00badw", b"goodone", b"\x00good", b""], object)[:-1]
    counts = np.array([[40.0, 0], [90, 0], [5, 50], [5, 60]])
    odds = toxicity._odds(words, counts, np.array([100.0, 100.0]))
    assert odds[b"badword"] > 2 and odds[b"badwish"] > 2 and odds[b"goodish"] < -1 and odds[b"else"] == -toxicity.DRIFT
    assert odds[b"badword"] > odds[b"badwish"] - 2


def held_out(spark):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = QUERIES["op13_toxicity"](spark, FOLDER).collect()
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = held_out(spark)
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hit = sum(p and t for p, t in judged)
    assert hit / sum(p for p, _ in judged) > 0.93 and hit / sum(t for _, t in judged) > 0.85


def test_labels_of_held_out_rows_do_not_count(spark):
    """Turning the labels of all held-out rows round leaves every score as it is."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.remainder() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(tuple, toxicity.toxicity(docs, toxicity.trained(docs, some)).collect())) for some in (labels, turned)]
    assert scores[0] == scores[1]


def labelled(spark, n=400):
    """Clean texts, and toxic ones that hold a passage of three words of a family."""
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{w}" for w in r.zipf(1.5, 60) % 500]
        if i % 8 == 0:
            at = int(r.integers(0, 50))
            words[at:at + 3] = [f"scum{w}" for w in r.integers(0, 30, 3)]
        rows.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(i % 8 == 0), 1))
    return (spark.createDataFrame(rows, "doc_id long, text string, passage string, score double"),
            spark.createDataFrame(labels, "doc_id long, toxic int, score int"))


def test_passages(spark):
    docs, labels = labelled(spark)
    model = toxicity.trained(docs, labels)
    assert model.rate > 0 and model.slope > 0
    found = toxicity.toxic_passages(docs, model).collect()
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for p in found:
        assert " ".join(texts[p["doc_id"]][p["first_word"]:p["last_word"] + 1]) == p["passage"] and p["expected"] < toxicity.SIGNIFICANT
    with_scum = {p["doc_id"] for p in found if "scum" in p["passage"]}
    # One clean text in twenty has such a passage by chance; the law is fitted to few texts here.
    assert len(with_scum) >= 45 and len({p["doc_id"] for p in found} - with_scum) <= 0.12 * 350


def test_odd_rows(spark):
    """NULL and empty texts, a NULL id, repeated rows and ids, clashing columns, contradicting and odd labels, a very long text."""
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(1000, None, "x", 1.0), (1001, "", "x", 1.0), (None, "scum1 scum2", "x", 1.0), (None, None, None, None),
                                 (1002, "scum1 scum2 scum3", "x", 1.0), (1002, "scum1 scum2 scum3", "x", 1.0), (1002, "word1", "x", 1.0),
                                 (1003, "word1 word2 " * 300_000 + "scum1 scum2 scum3 scum4", "x", 1.0)], docs.schema)
    more = spark.createDataFrame([(None, 1, 1), (3, None, 1), (3, 5, 1), (0, 0, 1), (1002, 1, 1)], labels.schema)
    both = docs.unionByName(odd)
    model = toxicity.trained(both, labels.unionByName(more))
    scores = toxicity.toxicity(both, model).collect()
    assert len(scores) == 408
    by = {}
    for r in scores:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[1000] == by[1001] and by[1000][0] < 0.1 and len(by[1002]) == 3 and len(by[None]) == 2 and min(by[1002]) < 0.1 < max(by[1002])
    assert by[1003][0] > by[1000][0]
    assert any(p["doc_id"] == 1003 and p["last_word"] == 600_003 for p in toxicity.toxic_passages(both, model).collect())


def test_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 40)
    for kept, score in (("false", 0.0), ("toxic = 0", 0.0), ("toxic = 1", 1.0)):
        assert {r["score"] for r in toxicity.toxicity(docs, toxicity.trained(docs, labels.filter(kept))).collect()} == {score}
    none = docs.filter("false")
    assert toxicity.toxicity(none, toxicity.trained(none, labels)).collect() == []


def test_sample_is_bounded_and_equal_texts_count_once(spark):
    docs, labels = labelled(spark)
    many = docs.filter("doc_id = 1").crossJoin(spark.range(300)).selectExpr("id + 5000 AS doc_id", "text", "passage", "score")
    sample, totals = toxicity.sampled(docs.unionByName(many), labels.unionByName(many.selectExpr("doc_id", "0 AS toxic", "1 AS score")), 50)
    assert sum(totals) > 400 and sample.count() <= 100 and sample.count() == sample.select("text").distinct().count()
