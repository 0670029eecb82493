"""Ranked lexical search: for every item the documents of highest score, exactly, by norm buckets.

The score of a document is an inner product: its impact vector has w(term) * impact(term, document) for each term it holds, an item's vector is
1 at each of its distinct terms.

1. Items are taken in blocks of a bounded number of bytes; a block's vocabulary is broadcast.  One pass over all texts keeps
   each document's counts of these terms, together with the corpus figures.
2. Impact vectors are range-sorted by falling length (norm).  A task reads its range in buckets of ``BUCKET`` neighbours.
3. For an item with the k-th best score theta so far: the inner product is at most the product of the norms (Cauchy-Schwarz), so buckets
   after the first whose norm is too short are left out; nor can a document of a bucket score more than the sum of the bucket's maxima on the
   item's coordinates.  Inside the buckets that are left, the terms of smallest maxima that together stay below theta are put aside: only
   documents that hold one of the other terms are candidates, and their partial sums plus the bucket's maxima of the terms put
   aside bound them again.
4. Survivors are scored again in 64-bit integers; a task keeps k per item.

theta starts at the k-th score among a share of the documents drawn by hash (``SEEDS``), found by the same search: a lower bound of the
final one, so that a task rarely sends more than a few rows.  Results do not depend on the draw.

NULL texts hold no term.  A row is a document, a row of items an item: repeated rows are ranked each.  Equal scores go by ascending
doc_id, NULL last.  Items without a matching document, documents and items without terms give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.llm.base import Sender, as_batch, kept, query, rows, table, term_lists, text_bytes
from sluice.llm.running import running_before
from sluice.session import stored

K = 50
# Bytes of item texts in a block; a longer item is a block of its own.
ITEM_BYTES = 4 << 20
# Documents of a bucket, and of the batch of buckets that a task has in memory (the first of a task is smaller).
BUCKET = 128
BATCH = 16_384
FIRST_BATCH = 512
# Postings of a batch.
BATCH_POSTINGS = 4_000_000
# One document in so many, but this number at least, sets the first thetas.
SEEDS = 64
LEAST_SEEDS = 2000

NO_DOC = (1 << 63) - 1
# Bounds are in doubles and rounded up by this.
SLACK = 1 + 1e-9

_COUNTS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary()), ("what", pa.int32()), ("count", pa.int64())])
_COUNTS_DDL = "doc long, n long, terms binary, tf binary, what int, count long"
_IMPACTS = pa.schema([("doc", pa.int64()), ("norm", pa.float64()), ("terms", pa.binary()), ("impacts", pa.binary())])
_IMPACTS_DDL = "doc long, norm double, terms binary, impacts binary"
_FOUND = pa.schema([("item", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "item int, doc long, score long"
# ``what`` of the corpus figures; a term's own number stands for its document frequency.
DOCUMENTS, TERMS_IN_ALL = -1, -2


def _counter(vocabulary):
    """Documents that hold terms of the vocabulary, and this task's corpus figures."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.value.get
        holding = np.zeros(len(vocabulary.value), np.int64)
        documents = total = 0
        send = Sender(_COUNTS)
        for doc, text in rows(batches):
            n, found = 0, Counter()
            for words in term_lists(text):
                n += len(words)
                found.update(map(find, words))
            found.pop(None, None)
            documents += n > 0
            total += n
            if found:
                terms = np.fromiter(found, np.int32, len(found))
                order = np.argsort(terms)
                tf = np.fromiter(found.values(), np.int64, len(found))[order]
                terms = terms[order]
                holding[terms] += 1
                if send.add((doc, n, terms.tobytes(), tf.astype(np.int64).tobytes(), None, None), 12 * len(terms)):
                    yield send.take()
        for what, figure in ((DOCUMENTS, documents), (TERMS_IN_ALL, total)):
            send.add((None, None, None, None, what, figure))
        for term in np.flatnonzero(holding).tolist():
            send.add((None, None, None, None, term, int(holding[term])))
        yield send.take()

    return count


def _impacts(weights, documents: int, total: int):
    """Counts to impacts (whole numbers below a million) and the norm of the weighted vector."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(_IMPACTS)
        w = weights.value
        for doc, n, terms, tf in rows(batches):
            m = 50 + 50 * n * documents // total
            # Above 10^9 the count no longer moves the quotient, whose last digit 64 bits could not hold.
            counts = np.frombuffer(tf, np.int64)
            if int(counts.max()) < 1_000_000_000 and m < 1 << 58:
                impact = (1_000_000_000 * counts) // (1000 * counts + 20 * m)
            else:
                impact = np.array([1_000_000_000 * c // (1000 * c + 20 * m) for c in counts.tolist()], np.int64)
            vector = (w[np.frombuffer(terms, np.int32)] * impact).astype(np.float64)
            if send.add((doc, math.sqrt(float(vector @ vector)), terms, impact.astype(np.int32).tobytes()), 8 * len(impact)):
                yield send.take()
        yield send.take()

    return weigh


class _Batch:
    """Postings of neighbouring documents by term, and the maxima of their buckets."""

    def __init__(self, docs: list[int], norms: list[float], terms: list[bytes], impacts: list[bytes], weights: np.ndarray):
        self.docs = np.array(docs, np.int64)
        sizes = np.array([len(t) // 4 for t in terms])
        term = np.frombuffer(b"".join(terms), np.int32)
        order = np.argsort(term, kind="stable")
        term = term[order]
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)[order]
        self.value = weights[term] * np.frombuffer(b"".join(impacts), np.int32)[order]
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.buckets = -(-len(docs) // BUCKET)
        self.norms = np.array(norms[::BUCKET]) * SLACK
        bucket = self.doc // BUCKET
        edge = np.flatnonzero(np.diff(term.astype(np.int64) * self.buckets + bucket, prepend=-1))
        self.most = np.maximum.reduceat(self.value, edge).astype(np.float64) if len(edge) else np.zeros(0)
        self.most_bucket = bucket[edge]
        self.most_start = np.searchsorted(term[edge], np.arange(len(weights) + 1))

    def postings(self, term: int) -> slice:
        return slice(self.start[term], self.start[term + 1])

    def maxima(self, term: int) -> slice:
        return slice(self.most_start[term], self.most_start[term + 1])

    def search(self, terms: np.ndarray, norm: float, theta: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of all documents that score ``theta`` (1 at least) or more; others may be among them."""
        theta = max(theta, 1)
        nothing = np.zeros(0, np.int64)
        # Norms fall, so the buckets that Cauchy-Schwarz leaves come first.
        live = np.arange(self.buckets) < np.searchsorted(-self.norms * norm, -theta, side="right")
        here = [t for t in terms.tolist() if self.start[t + 1] > self.start[t]]
        if not live.any() or not here:
            return nothing, nothing
        bound = np.zeros(self.buckets)
        for t in here:
            cut = self.maxima(t)
            bound[self.most_bucket[cut]] += self.most[cut]
        live &= bound * SLACK >= theta
        if not live.any():
            return nothing, nothing
        tops = {t: float(self.most[self.maxima(t)].max()) for t in here}
        here.sort(key=tops.get)
        aside = 0
        below = 0.0
        while aside < len(here) and (below + tops[here[aside]]) * SLACK < theta:
            below += tops[here[aside]]
            aside += 1
        if aside == len(here):
            return nothing, nothing
        partial = np.zeros(len(self.docs))
        for t in here[aside:]:
            cut = self.postings(t)
            partial[self.doc[cut]] += self.value[cut]
        rest = np.zeros(self.buckets)
        for t in here[:aside]:
            cut = self.maxima(t)
            rest[self.most_bucket[cut]] += self.most[cut]
        own = np.arange(len(self.docs)) // BUCKET
        left = np.flatnonzero((partial > 0) & live[own] & ((partial + rest[own]) * SLACK >= theta))
        scores = np.zeros(len(left), np.int64)
        if 16 * len(left) >= len(self.docs):
            whole = np.zeros(len(self.docs), np.int64)
            for t in here:
                cut = self.postings(t)
                whole[self.doc[cut]] += self.value[cut]
            scores = whole[left]
        elif len(left):
            for t in here:
                cut = self.postings(t)
                there = self.doc[cut]
                at = np.minimum(np.searchsorted(there, left), len(there) - 1)
                scores += np.where(there[at] == left, self.value[cut][at], 0)
        good = scores >= theta
        return left[good], scores[good]


def _searcher(items, weights, thetas: np.ndarray, k: int):
    """The k best of this task's documents per item, theta or better.  Rows come by falling norm or in any order."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = items.value, weights.value
        norms = [math.sqrt(len(t)) * SLACK for t in asked]
        theta = thetas.tolist()
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        held: list[tuple] = []
        postings, limit = 0, FIRST_BATCH

        def run() -> None:
            held.sort(key=lambda r: -r[1])
            batch = _Batch(*map(list, zip(*held, strict=True)), w)
            for i, terms in enumerate(asked):
                at, scores = batch.search(terms, norms[i], theta[i])
                if not len(at):
                    continue
                docs, scores = np.concatenate([best[i][0], batch.docs[at]]), np.concatenate([best[i][1], scores])
                top = np.lexsort((docs, -scores))[:k]
                best[i] = docs[top], scores[top]
                if len(top) == k:
                    theta[i] = max(theta[i], int(scores[top[-1]]))

        for row in rows(batches):
            held.append(row)
            postings += len(row[2]) // 4
            if len(held) >= limit or postings >= BATCH_POSTINGS:
                run()
                held, postings, limit = [], 0, min(BATCH, 4 * limit)
        if held:
            run()
        for i, (docs, scores) in enumerate(best):
            if len(docs):
                yield as_batch(_FOUND, np.full(len(docs), i, np.int32), docs, scores)

    return search


def _blocks(items: DataFrame, size: int) -> DataFrame:
    """item_id, text (bytes) and the block of every item."""
    sized = items.select("item_id", text_bytes().alias("text")).withColumn("_size", F.octet_length("text") + F.lit(64))
    before = running_before(sized, F.lit(0), [F.col("item_id"), F.col("text")], F.col("_size"), "_before")
    return before.select("item_id", "text", F.expr(f"_before div {size}").cast("bigint").alias("block"))


def _search_block(docs: DataFrame, asked: list[tuple], k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items (item_id, text) of one block."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    lists = []
    for _, text in asked:
        terms = {w for words in term_lists(bytes(text)) for w in words}
        lists.append(np.array(sorted(vocabulary.setdefault(w, len(vocabulary)) for w in terms), np.int64))
    share = [spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(lists)]
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC)).alias("doc"), text_bytes().alias("text"))
    counted = kept(narrow.mapInArrow(_counter(share[0]), _COUNTS_DDL), "term-counts")
    # One row per term of the block.
    figures = {r["what"]: r["n"] for r in counted.filter(F.col("what").isNotNull()).groupBy("what").agg(F.sum("count").alias("n")).collect()}
    n_docs, total = figures.get(DOCUMENTS, 0), figures.get(TERMS_IN_ALL, 0)
    weights = np.zeros(len(vocabulary), np.int64)
    for term in range(len(vocabulary)):
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * figures.get(term, 0) + 1)))
    share.append(spark.sparkContext.broadcast(weights))
    vectors = counted.filter(F.col("what").isNull()).select("doc", "n", "terms", "tf").mapInArrow(_impacts(share[2], n_docs, total or 1), _IMPACTS_DDL)

    one_in = max(1, min(SEEDS, n_docs // LEAST_SEEDS))
    drawn = vectors.filter(F.pmod(F.xxhash64("doc", "terms"), F.lit(one_in)) == 0)
    seeds = drawn.mapInArrow(_searcher(share[1], share[2], np.zeros(len(lists), np.int64), k), _FOUND_DDL)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    # At most one row per item.
    first = seeds.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("item", "score").collect()
    thetas = np.zeros(len(lists), np.int64)
    for row in first:
        thetas[row["item"]] = row["score"]

    ordered = vectors.repartitionByRange(F.desc("norm"), "doc").sortWithinPartitions(F.desc("norm"), "doc")
    found = ordered.mapInArrow(_searcher(share[1], share[2], thetas, k), _FOUND_DDL)
    names = F.broadcast(spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asked)], "item int, item_id long"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = stored(ranked.join(names, "item").select("item_id", "rank", F.when(F.col("doc") != F.lit(NO_DOC), F.col("doc")).alias("doc_id"), "score"))
    for shared in share:
        shared.destroy()
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    blocks = stored(_blocks(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text"), item_bytes))
    found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for row in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        asked = blocks.filter(F.col("block") == row["block"]).select("item_id", "text").collect()
        found = found.unionByName(_search_block(docs, [tuple(r) for r in asked], k))
    return found


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
f AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS total FROM d),
q AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), f),
s AS (
  SELECT q.i, q.item_id, d.r, d.doc_id,
    sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(d.terms) * f.n_docs) // f.total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), f GROUP BY q.i, q.item_id, d.r, d.doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


@query("op12_ranked_search", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
