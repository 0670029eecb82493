"""Language-model scores by logistic mixing of hashed-context bit predictors.

Base: add-one unigrams over words and one end per text.

Model: a word is its bytes and a blank; the end of a text is a lone blank.  Each bit is predicted by ``CONTEXTS`` tables of counts:
the byte's place in the word, the last one, two, three and five bytes, and the whole word so far, each hashed together with the bits of the
byte that are known.  The predictions (in the logistic domain) are combined by weights that are selected by two gates, the bit's number
and how often the longest context was seen; an adaptive map refines the result.  Word probabilities are mixed with the unigrams, with the
share under which the training words are likeliest.

Training reads all words of the training documents (crc32 of doc_id is not ``HELD`` modulo ``FOLDS``), none is drawn or left out:

* their counts, and from those the bit counts, whose tables are of fixed size (``SLOTS`` per context) and added up by grouped aggregation;
* mixing weights and map, from every bit of every different word, predicted without the word's own contribution to the counts.  Words are dealt by
  hash to learners of about ``LEARNER_WORDS``, which move their weights by a Newton step per group of words.  What they have seen is added up by gate:
  curvatures and the weights they call for, visits and ones of the map's cells.  The weights are the learners' mean, each counting by its curvature;
* the share, from the scores of all training words without their own contribution, by sums over the table of scored words.

Flow: documents are dealt into blocks of about ``BLOCK_BYTES`` of text; each block sends each of its different words once, with its count in training
documents.  Grouping by word gives totals and the blocks that asked.  Each different word is scored once and sent to its blocks, where
documents look their words up.  No table of words is broadcast.

NULL text is empty: its only token is the end.  A NULL doc_id counts as training.  Rows that repeat are documents of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.base import as_batch, file_bytes, kept, query, rows, slices, table, text_bytes

FOLDS, HELD = 7, 2
BLOCK_BYTES = 20 << 20
CONTEXTS = 6
SLOTS = 1 << 18
# Different words a learner takes; their number bounds a task, not what is learned.
LEARNER_WORDS = 1 << 16
# Counts of a table that travel together.
CELLS = 4096
# Longer words are scored by their first and last bytes' contexts all the same, in groups of so many bits.
LANES = 8192
GATES = 5
# Before anything is learned: the weight of every input, its curvature, and the visits for which a cell of the map stands.
WEIGHT, CURVATURE, VISITS = 0.3, 100.0, 20.0
MAP = 1 / (1 + np.exp(-np.linspace(-8, 8, 33)))
# Shares are tried in two rounds of so many steps.
STEPS = 32

_BLANK = 32
_WORD = pa.schema([("word", pa.binary()), ("block", pa.int32()), ("n", pa.int64())])


def _bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, bit number 0-7, slots by context, bit) for every bit of every word."""
    data = b"".join([w + b" " for w in words])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    byte = np.frombuffer(data, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(byte)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def back(k: int) -> np.ndarray:
        out = np.zeros_like(byte)
        out[k:] = byte[:-k] if k else byte
        return np.where(place >= k, out, np.uint64(0))

    odd = np.uint64(0x9E3779B97F4A7C15)
    one, two, three, four, five = (back(k) for k in range(1, 6))
    two_ = one | two << np.uint64(8)
    three_ = two_ | three << np.uint64(16)
    five_ = three_ | four << np.uint64(24) | five << np.uint64(32)
    whole = np.zeros_like(byte)
    # Hash of the word so far, by length classes: all words advance one byte at a time.
    starts = np.cumsum(lengths) - lengths
    state = np.zeros(len(words), np.uint64)
    alive = np.arange(len(words))
    for i in range(int(lengths.max()) if len(words) else 0):
        alive = alive[lengths[alive] > i]
        at = starts[alive] + i
        whole[at] = state[alive]
        state[alive] = (state[alive] ^ (byte[at] + np.uint64(1))) * odd
        state[alive] ^= state[alive] >> np.uint64(29)
    histories = [np.minimum(place, 15).astype(np.uint64), one, two_, three_, five_, whole]
    shift = np.arange(7, -1, -1, dtype=np.uint64)
    bit = ((byte[:, None] >> shift) & np.uint64(1)).astype(np.int8)
    node = (np.uint64(256) | byte)[:, None] >> (shift + np.uint64(1))
    node *= np.uint64(0xD1342543DE82EF95)
    slots = np.empty((CONTEXTS, bit.size), np.int32)
    for i, h in enumerate(histories):
        x = (h * odd + np.uint64(i))[:, None] + node
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(31)
        x *= odd
        x >>= np.uint64(40)
        x %= np.uint64(SLOTS)
        slots[i] = x.ravel()
        slots[i] += i * SLOTS
    return np.repeat(owner, 8), np.tile(np.arange(8), len(byte)), slots, bit.ravel()


def _groups(words: list[bytes]) -> Iterator[list[int]]:
    """Places of words, about ``LANES`` bytes at a time; a long word is a group of its own."""
    group, size = [], 0
    for i, w in enumerate(words):
        group.append(i)
        size += len(w) + 1
        if size >= LANES:
            yield group
            group, size = [], 0
    if group:
        yield group


class Mixer:
    """Tables, mixing weights and the adaptive map."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # (contexts * slots, 2)
        self.weights = np.full((8 * GATES, CONTEXTS + 1), WEIGHT)
        self.map = np.tile(MAP, (8 * GATES, 1))

    @cached_property
    def logits(self) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every slot by all counts; and two for each slot, without a zero and without a one of the word's own."""
        zero, one = self.counts[:, 0], self.counts[:, 1]
        log = lambda n: np.log(np.maximum(n, 0) + 0.05)
        full = log(one) - log(zero)
        without = np.stack([log(one) - log(zero - 1), log(one - 1) - log(zero)], axis=1)
        return full.astype(np.float32), without.astype(np.float32).ravel()

    @cached_property
    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Gate of every slot of the longest context, by all counts and without the word's own bit."""
        seen = self.counts[(CONTEXTS - 1) * SLOTS:].sum(axis=1)
        full, without = (np.minimum(np.ceil(np.log2(np.maximum(n, 0) + 1) / 3), GATES - 1).astype(np.uint8) for n in (seen, seen - 1))
        return full, without

    def inputs(self, slots: np.ndarray, number: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(logits by context and a constant, gate); ``own``: the bit that each place has added to the counts itself, to be left out."""
        x = np.ones((CONTEXTS + 1, slots.shape[1]), np.float32)
        for row, at in zip(x, slots, strict=False):
            if own is None:
                np.take(self.logits[0], at, out=row, mode="clip")
            else:
                np.take(self.logits[1], 2 * at + own, out=row, mode="clip")
        return x, number * GATES + self.gates[own is not None][slots[-1] - (CONTEXTS - 1) * SLOTS]

    def probability(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of a one, mixed probability before the map, cell of the map)."""
        z = np.zeros(len(gate))
        for row, weights in zip(x, self.weights.T.copy(), strict=True):
            z += row * weights[gate]
        z = np.clip(z, -8, 8)
        mixed = 1 / (1 + np.exp(-z))
        cell = np.rint((z + 8) * 2).astype(np.int64)
        return np.clip((mixed + self.map[gate, cell]) / 2, 1e-6, 1 - 1e-6), mixed, cell

    def learn(self, words: list[bytes]) -> np.ndarray:
        """What ``words`` teach, a row per gate to be added up over learners: curvature, curvature times weights, visits and ones of the map's cells."""
        n = CONTEXTS + 1
        prior = np.eye(n) * CURVATURE
        curvature = np.tile(prior, (8 * GATES, 1, 1))
        visits, ones = np.zeros((2, *self.map.shape))
        for group in _groups(words):
            _, number, slots, bit = _bits([words[i] for i in group])
            x, gate = self.inputs(slots, number, bit)
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            x, bit, ends = x[:, order], bit[order], np.cumsum(np.bincount(gate, minlength=8 * GATES))
            pull = np.zeros_like(self.weights)
            for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if a == b:
                    continue
                part = x[:, a:b]
                z = np.clip(self.weights[g].astype(np.float32) @ part, -8, 8)
                mixed = 1 / (1 + np.exp(-z))
                pull[g] = part @ (bit[a:b] - mixed)
                curvature[g] += (part * (mixed * (1 - mixed))) @ part.T
                cell = np.rint((z + 8) * 2).astype(np.int64)
                visits[g] += np.bincount(cell, minlength=len(MAP))
                ones[g] += np.bincount(cell, bit[a:b], minlength=len(MAP))
            self.weights = self.weights + np.linalg.solve(curvature, pull[:, :, None])[:, :, 0]
        called = np.einsum("gij,gj->gi", curvature, self.weights) - CURVATURE * WEIGHT
        return np.concatenate([(curvature - prior).reshape(len(called), -1), called, visits, ones], axis=1)

    def settle(self, gate: int, seen: np.ndarray) -> None:
        """Weights and map of a gate from what all learners have seen."""
        n = CONTEXTS + 1
        curvature, called, visits, ones = np.split(seen, np.cumsum([n * n, n, len(MAP)]))
        self.weights[gate] = np.linalg.solve(curvature.reshape(n, n) + np.eye(n) * CURVATURE, called + CURVATURE * WEIGHT)
        self.map[gate] = (ones + VISITS * MAP) / (visits + VISITS)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word by the bit model."""
        return self.scores(words, np.zeros(len(words), bool))[0]

    def scores(self, words: list[bytes], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities by the bit model, for known words also without their own contribution to the counts."""
        out = np.zeros((2, len(words)))
        for group in _groups(words):
            owner, number, slots, bit = _bits([words[i] for i in group])
            out[0, group] = self._sums(owner, bit, *self.inputs(slots, number), len(group))
            mine = known[group]
            if mine.any():
                if not mine.all():
                    some = mine[owner]
                    owner, number, slots, bit = owner[some], number[some], slots[:, some], bit[some]
                out[1, group] = self._sums(owner, bit, *self.inputs(slots, number, bit), len(group))
        return out[0], out[1]

    def _sums(self, owner: np.ndarray, bit: np.ndarray, x: np.ndarray, gate: np.ndarray, n: int) -> np.ndarray:
        p, _, _ = self.probability(x, gate)
        return np.bincount(owner, np.log10(np.where(bit == 1, p, 1 - p)), minlength=n)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: each different word of a block once, with its training tokens."""
    block, learned = None, Counter()

    def out() -> Iterator[pa.RecordBatch]:
        items = iter(learned.items())
        while part := list(islice(items, 20_000)):
            yield as_batch(_WORD, [w for w, _ in part], [block] * len(part), [n for _, n in part])

    for batch in batches:
        for b, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                yield from out()
                block, learned = b, Counter()
            words = text.lower().split()
            words.append(b"")
            if held:
                for word in words:
                    learned.setdefault(word, 0)
            else:
                learned.update(words)
    yield from out()


_CHUNK = pa.schema([("chunk", pa.int32()), ("cells", pa.list_(pa.float64()))])


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((CONTEXTS * SLOTS, 2))
    flat = counts.reshape(-1)
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("c").to_numpy()
        for group in _groups(words):
            owner, _, slots, bit = _bits([words[i] for i in group])
            weight = n[group][owner].astype(float)
            for i in range(CONTEXTS):
                np.add.at(flat, slots[i] * 2 + bit, weight)
    for i in range(0, len(flat), CELLS):
        part = flat[i:i + CELLS]
        if part.any():
            yield as_batch(_CHUNK, [i // CELLS], [part])


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, whose cells are added up in the order of the rows."""
    chunk, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = batch.column("chunk").to_pylist()
        cells = batch.column("cells").flatten().to_numpy().reshape(len(numbers), -1)
        for number, row in zip(numbers, cells, strict=True):
            if number != chunk:
                if total is not None:
                    yield as_batch(_CHUNK, [chunk], [total])
                chunk, total = number, np.zeros(len(row))
            total = total + row
    if total is not None:
        yield as_batch(_CHUNK, [chunk], [total])


_SEEN = pa.schema([("learner", pa.int32()), *_CHUNK])


def _learner(counts):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (learner, word) sorted by learner; a chunk for each gate."""
        mixer = Mixer(counts.value)
        for learner, part in groupby(rows(batches), itemgetter(0)):
            mixer.weights = np.full_like(mixer.weights, WEIGHT)
            seen = mixer.learn([word for _, word in part])
            yield as_batch(_SEEN, [learner] * len(seen), range(len(seen)), list(seen))

    return learn


def _word_scorer(counts, weights: np.ndarray, cells: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(counts.value)
        mixer.weights, mixer.map = weights, cells
        for batch in slices(batches, 10_000):
            words = batch.column("word").to_pylist()
            bits, others = mixer.scores(words, batch.column("c").to_numpy() > 0)
            keys = [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words]
            yield pa.record_batch([pa.array(keys, pa.int64()), batch.column("c"), pa.array(bits), pa.array(others), batch.column("blocks")],
                                  names=["key", "c", "bits", "others", "blocks"])

    return score


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


class _Look(dict):
    """Place of a word in its block's table."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]

    def __missing__(self, word: bytes) -> int:
        at = int(self.sorted.searchsorted(xxhash.xxh3_64_intdigest(word) - (1 << 63)))
        self[word] = place = int(self.order[at])
        return place


def _scorer(total: int, kinds: int):
    def score(docs: pa.Table, words: pa.Table) -> pa.Table:
        counts, scores = words.column("c").to_numpy(), words.column("score").to_numpy()
        look = _Look(words.column("key").to_numpy())
        base = np.log10((counts + 1) / (total + kinds + 1))
        out: list[list] = [[] for _ in range(8)]
        for doc_id, text, held in rows(docs.select(["doc_id", "text", "held"]).to_batches(max_chunksize=64)):
            tokens = text.lower().split()
            tokens.append(b"")
            at = np.fromiter(map(look.__getitem__, tokens), np.int64, len(tokens))
            model = float(scores[at].sum())
            size = sum(map(len, tokens)) + len(tokens)
            for column, value in zip(out, (doc_id, held, len(tokens), int((counts[at] > 0).sum()), total, float(base[at].sum()), model,
                                           -model / math.log10(2) / size), strict=True):
                column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _OUT, strict=True)], schema=_OUT)

    return score


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, learner_words: int = LEARNER_WORDS) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text); see ``_OUT`` for the columns."""
    spark = docs.sparkSession
    blocks = max(1, -(-file_bytes(docs) // block_bytes))
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"),
        (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD).alias("held"),
    ).repartition(blocks, "block")
    asked = (dealt.sortWithinPartitions("block").select("block", "text", "held")
             .mapInArrow(_collect, "word binary, block int, n long"))
    words = kept(asked.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list("block").alias("blocks")), "words")
    found = words.filter("c > 0").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = int(found["total"] or 0), int(found["kinds"] or 0)
    mixer, counts = train(words, kinds, learner_words)
    bits = kept(words.select("word", "c", "blocks").mapInArrow(_word_scorer(counts, mixer.weights, mixer.map),
                                                               "key long, c long, bits double, others double, blocks array<int>"), "bits")
    share = fit_share(bits, total, kinds)
    model = F.pow(F.lit(10.0), F.greatest("bits", F.lit(-300.0)))
    unigram = F.when(F.col("c") > 0, (F.col("c") + 1) / F.lit(float(total + kinds + 1))).otherwise(0.0)
    scored = (bits.select("key", "c", F.log10(F.lit(share) * unigram + F.lit(1 - share) * model).alias("score"), "blocks")
              .select(F.explode("blocks").alias("block"), "key", "c", "score"))
    return (dealt.groupBy("block").cogroup(scored.groupBy("block"))
            .applyInArrow(_scorer(total, kinds),
                          "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                          "score double, bits_per_byte double"))


def train(words: DataFrame, kinds: int, learner_words: int = LEARNER_WORDS) -> tuple[Mixer, Broadcast]:
    """Bit counts, weights and map from all training words; also the counts as a broadcast."""
    learned = words.filter("c > 0").select("word", "c")
    chunks = (learned.mapInArrow(_count_bits, "chunk int, cells array<double>").repartition("chunk").sortWithinPartitions("chunk")
              .mapInArrow(_add_chunks, "chunk int, cells array<double>"))
    flat = np.zeros(CONTEXTS * SLOTS * 2, np.float32)
    for row in chunks.toLocalIterator():  # a table of fixed size
        flat[row["chunk"] * CELLS:(row["chunk"] + 1) * CELLS] = row["cells"]
    mixer = Mixer(flat.reshape(-1, 2))
    counts = words.sparkSession.sparkContext.broadcast(mixer.counts)  # of fixed size
    learners = max(1, -(-kinds // learner_words))
    # Words in an order of their own, so that learners and their steps are the same in every run.
    dealt = (learned.select(F.pmod(F.xxhash64("word"), F.lit(learners)).cast("int").alias("learner"), "word", F.xxhash64(F.lit(1), "word").alias("_place"))
             .repartition(learners, "learner").sortWithinPartitions("learner", "_place", "word").select("learner", "word"))
    seen = (dealt.mapInArrow(_learner(counts), "learner int, chunk int, cells array<double>").repartition("chunk")
            .sortWithinPartitions("chunk", "learner").mapInArrow(_add_chunks, "chunk int, cells array<double>"))
    for row in seen.collect():  # one row a gate
        mixer.settle(row["chunk"], np.array(row["cells"]))
    return mixer, counts


def fit_share(bits: DataFrame, total: int, kinds: int) -> float:
    """The unigrams' share under which all training tokens are likeliest, to 1 in ``STEPS`` squared.  The slope over the share falls throughout."""
    unigram = F.when(F.col("c") > 1, F.col("c") / F.lit(float(total + kinds))).otherwise(0.0)
    known = bits.filter("c > 0").select("c", unigram.alias("u"), F.pow(F.lit(10.0), F.greatest("others", F.lit(-300.0))).alias("b"))
    low = 0.0
    for width in (1 / STEPS, 1 / STEPS**2):
        shares = [low + i * width for i in range(1, STEPS)]
        slopes = known.agg(*[F.sum(F.expr(f"c * (u - b) / ({s!r}D * u + {1 - s!r}D * b)")) for s in shares]).first()
        low = max([s for s, slope in zip(shares, slopes, strict=True) if slope is not None and slope > 0], default=low)
    return min(max(low, 0.01), 0.99)


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
