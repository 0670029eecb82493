"""Toxic passages as maximum-scoring segments, and a toxicity score per document.

1. Training texts: at most ``SAMPLE`` different texts of each class, drawn by hash from the labelled training rows.  Class totals are
   counted over all of these rows.
2. A word's log-odds: in how many toxic and clean training texts it stands (clean counts scaled to as many texts as are toxic), with a
   Dirichlet prior of ``PRIOR`` texts whose mean is the share of the word's stem (its first bytes), which has a prior around one half.  A model
   holds the ``WORDS`` words and ``STEMS`` stems that depart most from chance; any other word has its stem's odds.
3. A token scores its log-odds less ``DRIFT``.  One linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a text.
4. Extreme values: in n clean tokens the best segment exceeds S with an expected number of E = K n exp(-lambda S).  lambda and K are fitted
   by maximum likelihood to clean training texts, each scored by a model that was fitted on the other half of the sample.
5. A document's evidence is the sum of -ln E over its significant passages (E < 1), or -ln E of the best one where there is none; a logistic
   curve, fitted to the cross-scored sample and weighted to the class totals, turns it into a score between 0 and 1.

Whole texts are scored, in pieces whose segments go on across their borders.  NULL text is empty; an empty text has the least evidence.
Rows are scored one by one, so repeated rows and ids come back as often as they stand there.  Labels: of several rows of an id the
most toxic counts, NULL ids and NULL or other values do not; where documents repeat an id, its least text is the labelled one.  A NULL
doc_id is not held out.  Without training rows of both classes every score is the share of toxic rows (0 where there are none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.llm.base import Sender, kept, query, rows, table, term_lists, text_bytes

# Bounds of the classifier: different training texts per class, words and stems of a model.
SAMPLE = 20_000
WORDS = 200_000
STEMS = 50_000
# Texts that must hold a word before it has odds of its own.
LEAST = 3
PRIOR = 4.0
STEM_BYTES = 4
DRIFT = 0.5
# Expected number of passages as good by chance, below which a passage is reported.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
LOWEST = -8.0
# Different words of a task before its counts are handed on.
COUNTED = 200_000

_COUNT = pa.schema([("word", pa.binary()), ("toxic0", pa.int64()), ("clean0", pa.int64()), ("toxic1", pa.int64()), ("clean1", pa.int64())])
_COUNT_DDL = "word binary, toxic0 long, clean0 long, toxic1 long, clean1 long"
# Sets a stem apart from the word of the same letters; no word holds it.
_STEM = b"\x00"


class Odds(dict):
    """Score of a token: the word's own, else its stem's."""

    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float]):
        super().__init__(words)
        self.stems = stems

    def __missing__(self, word: bytes) -> float:
        return self.stems.get(word[:STEM_BYTES], -DRIFT)

    def __reduce__(self):
        return Odds, (dict(self), self.stems)


class Segments:
    """All maximal scoring segments of a sequence that comes in pieces; linear time."""

    def __init__(self):
        self.tokens = 0
        self.total = 0.0
        # Candidates: first and past-the-end token, total before and after; link: the nearest earlier one with a smaller total before.
        self.start: list[int] = []
        self.end: list[int] = []
        self.before: list[float] = []
        self.after: list[float] = []
        self.link: list[int] = []

    def feed(self, scores: np.ndarray) -> None:
        totals = self.total + np.cumsum(scores)
        good = np.flatnonzero(scores > 0)
        for i, after, score in zip(good.tolist(), totals[good].tolist(), scores[good].tolist(), strict=True):
            self._add(self.tokens + i, self.tokens + i + 1, after - score, after)
        self.tokens += len(scores)
        if len(scores):
            self.total = float(totals[-1])

    def _add(self, start: int, end: int, before: float, after: float) -> None:
        while True:
            j = len(self.before) - 1
            while j >= 0 and self.before[j] >= before:
                j = self.link[j]
            if j < 0 or self.after[j] >= after:
                break
            start, before = self.start[j], self.before[j]
            for held in (self.start, self.end, self.before, self.after, self.link):
                del held[j:]
        self.start.append(start)
        self.end.append(end)
        self.before.append(before)
        self.after.append(after)
        self.link.append(j)

    def scores(self) -> np.ndarray:
        return np.array(self.after) - np.array(self.before)


def scanned(odds: Odds, text: bytes) -> Segments:
    found = Segments()
    for words in term_lists(text):
        found.feed(np.fromiter(map(odds.__getitem__, words), np.float64, len(words)))
    return found


def evidence(scores: np.ndarray, tokens: int, rate: float, scale: float) -> float:
    """Sum of -ln E over significant segments, else that of the best one; ``LOWEST`` at least."""
    if not tokens:
        return LOWEST
    logs = rate * (scores if len(scores) else np.zeros(1)) - math.log(scale * tokens)
    best = float(logs.max())
    return max(LOWEST, float(logs[logs > 0].sum()) if best > 0 else best)


def fit_extremes(best: np.ndarray, tokens: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of maximum likelihood for the best scores of clean texts of these lengths."""
    if len(best) < 20 or not best.any():
        return 1.0, 0.1

    def slope(rate: float) -> float:
        weight = tokens * np.exp(-rate * (best - best.min()))
        return 1 / rate - best.mean() + float((weight * best).sum() / weight.sum())

    low, high = 0.05, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, float(len(best) / (tokens * np.exp(-low * best)).sum())


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, held by a weak prior where the classes do not overlap."""
    at = np.zeros(2)
    design = np.column_stack([np.ones(len(x)), x])
    prior = np.diag([1e-3, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -35, 35)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + prior, design.T @ (weight * (y - p)) - prior @ at)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), max(float(at[1]), 0.0)


@dataclass
class Model:
    """Scores of tokens, the law of chance segments, and the curve from evidence to a score."""

    odds: Odds = field(default_factory=lambda: Odds({}, {}))
    rate: float = 1.0
    scale: float = 0.1
    intercept: float = 0.0
    slope: float = 0.0

    def score(self, found: Segments) -> float:
        x = evidence(found.scores(), found.tokens, self.rate, self.scale)
        z = self.intercept + self.slope * x
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, list[int]]:
    """(text, toxic, fold) of the training texts, and how many labelled training ids are clean and toxic."""
    of = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder() != 1))
          .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")))
    totals = {r["_toxic"]: r["count"] for r in of.groupBy("_toxic").count().collect()}
    # At most ``most`` rows of each class.
    drawn = [of.filter(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(most) for c in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = (docs.select("doc_id", text_bytes().alias("text")).join(chosen, F.col("doc_id") == F.col("_id"))
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"))
             .groupBy("text").agg(F.max("toxic").alias("toxic")))
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    return kept(texts.select("text", "toxic", fold.alias("fold")), "toxicity-sample"), [totals.get(0, 0), totals.get(1, 0)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of texts that hold a word or stem, by fold and class."""
    send = Sender(_COUNT)
    held: dict[bytes, list[int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for word, n in held.items():
            if send.add((word, *n), len(word)):
                yield send.take()
        held.clear()

    for text, toxic, fold in rows(batches):
        at = 2 * fold + 1 - toxic
        words = {w for some in term_lists(text) for w in some}
        words |= {_STEM + w[:STEM_BYTES] for w in words}
        for word in words:
            if word not in held:
                held[word] = [0, 0, 0, 0]
            held[word][at] += 1
        if len(held) > COUNTED:
            yield from flush()
    yield from flush()
    yield send.take()


def _log_odds(toxic: np.ndarray, clean: np.ndarray, mean: np.ndarray | float) -> np.ndarray:
    p = (toxic + PRIOR * mean) / (toxic + clean + PRIOR)
    return np.log(p / (1 - p))


def _odds(words: np.ndarray, counts: np.ndarray, texts: np.ndarray) -> Odds:
    """Scores from counts (toxic, clean) per word and stem; ``texts``: training texts by class."""
    toxic, clean = counts[:, 0], counts[:, 1] * (texts[0] / max(texts[1], 1))
    stem = np.array([w[:1] == _STEM for w in words], bool)
    own = _log_odds(toxic[stem], clean[stem], 0.5)
    stems = dict(zip([w[1:] for w in words[stem]], own.tolist(), strict=True))
    means = 1 / (1 + np.exp(-np.array([stems.get(w[:STEM_BYTES], 0.0) for w in words[~stem]])))
    scores = _log_odds(toxic[~stem], clean[~stem], means) - DRIFT
    return Odds(dict(zip(words[~stem].tolist(), scores.tolist(), strict=True)), {s: v - DRIFT for s, v in stems.items()})


def _best(odds) -> DataFrame:
    """Tokens and segment scores of sample texts under the model of the other fold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("tokens", pa.int64()), ("best", pa.float64()), ("segments", pa.list_(pa.float64()))])
        send = Sender(schema)
        for text, toxic, fold in rows(batches):
            found = scanned(odds.value[1 - fold], text)
            scores = found.scores()
            if send.add((toxic, found.tokens, float(scores.max(initial=0.0)), scores.tolist()), 8 * len(scores)):
                yield send.take()
        yield send.take()

    return scan


def _evidence(rate: float, scale: float):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("x", pa.float64())])
        for batch in batches:
            out = [(toxic, evidence(np.array(segments), tokens, rate, scale)) for toxic, tokens, _, segments in rows([batch])]
            yield pa.record_batch([pa.array([r[i] for r in out], schema.field(i).type) for i in range(2)], schema=schema)

    return weigh


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from the labelled rows whose crc32(doc_id) % 3 is not 1; its size is bounded by the module's constants."""
    spark = docs.sparkSession
    sample, totals = sampled(docs, labels, most)
    if not all(totals):
        share = totals[1] / max(sum(totals), 1)
        return Model(intercept=math.log(share / (1 - share)) if 0 < share < 1 else 1000.0 if share else -1000.0)
    sizes = np.zeros((2, 2))
    for r in sample.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"], 1 - r["toxic"]] = r["count"]
    base = sizes.sum(axis=0)
    counted = kept(sample.mapInArrow(_counts, _COUNT_DDL).groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNT.names[1:]]), "toxicity-words")
    n = F.col("toxic0") + F.col("toxic1") + F.col("clean0") + F.col("clean1")
    share = float(base[0] / base.sum()) if base.sum() else 0.5
    apart = F.abs(F.col("toxic0") + F.col("toxic1") - n * share) / F.sqrt(n * (share * (1 - share) + 1e-9))
    is_stem = F.substring("word", 1, 1) == F.lit(bytearray(_STEM))
    parts = [counted.filter(which & (n >= LEAST)).orderBy(apart.desc(), "word").limit(limit).toArrow()
             for which, limit in ((~is_stem, WORDS), (is_stem, STEMS))]
    held = pa.concat_tables(parts)
    words = np.array(held.column("word").to_pylist() + [b""], object)[:-1]
    counts = np.column_stack([held.column(c).to_numpy() for c in _COUNT.names[1:]]).astype(np.float64)
    folds = [_odds(words, counts[:, 2 * f:2 * f + 2], sizes[f]) for f in (0, 1)]
    shared = spark.sparkContext.broadcast(folds)
    scans = kept(sample.mapInArrow(_best(shared), "toxic int, tokens long, best double, segments array<double>"), "toxicity-scans")
    # At most ``most`` rows of each class, a few numbers each.
    clean = scans.filter("toxic = 0 AND tokens > 0").select("tokens", "best").toArrow()
    rate, scale = fit_extremes(clean.column("best").to_numpy(), clean.column("tokens").to_numpy().astype(np.float64))
    seen = scans.mapInArrow(_evidence(rate, scale), "toxic int, x double").toArrow()
    shared.destroy()
    y = seen.column("toxic").to_numpy().astype(np.float64)
    weight = np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))
    intercept, slope = fit_curve(seen.column("x").to_numpy(), y, weight / weight.mean())
    return Model(_odds(words, counts[:, :2] + counts[:, 2:], base), rate, scale, intercept, slope)


def _scorer(model):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        m = model.value
        for batch in batches:
            ids = batch.column("doc_id")
            out = [m.score(scanned(m.odds, text)) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([ids, pa.array(out, pa.float64())], schema=schema)

    return scores


def _passages(model, most_expected: float):
    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("log_odds", pa.float64()),
                            ("expected", pa.float64()), ("passage", pa.binary())])
        m = model.value
        send = Sender(schema)
        for doc_id, text in rows(batches):
            found = scanned(m.odds, text)
            good = [(a, b, s, m.scale * found.tokens * math.exp(-m.rate * s)) for a, b, s in
                    zip(found.start, found.end, found.scores().tolist(), strict=True)]
            good = [g for g in good if g[3] < most_expected]
            if not good:
                continue
            at = 0
            said: list[list[bytes]] = [[] for _ in good]
            for words in term_lists(text):
                for k, (a, b, _, _) in enumerate(good):
                    if a < at + len(words) and b > at:
                        said[k] += words[max(a - at, 0):b - at]
                at += len(words)
            for (a, b, s, e), some in zip(good, said, strict=True):
                passage = b" ".join(some)
                if send.add((doc_id, a, b - 1, s, e, passage), len(passage)):
                    yield send.take()
        yield send.take()

    return passages


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of ``docs`` (doc_id, text)."""
    return _narrow(docs).mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def toxic_passages(docs: DataFrame, model: Model, most_expected: float = SIGNIFICANT) -> DataFrame:
    """doc_id, first_word, last_word, log_odds, expected (number by chance), passage (its words): every significant passage."""
    found = _narrow(docs).mapInArrow(_passages(docs.sparkSession.sparkContext.broadcast(model), most_expected),
                                     "doc_id long, first_word long, last_word long, log_odds double, expected double, passage binary")
    return found.withColumn("passage", F.col("passage").cast("string"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
