"""Substring de-duplication by seed and extend over winnowed anchors.

A window is ``LENGTH`` consecutive words.  Each word covered by a window whose words also start earlier (smaller doc_id, or
same document and earlier start) is removed; windows are judged on the input.

1. Seed.  A window's anchor is the leftmost least hash among its ``SEED``-word runs.  It depends on the window's words only, so equal
   windows have equal anchors at equal offsets.  Windows of one document that share an anchor form a stretch.
2. Extend.  A stretch's anchor is extended both ways to all words its windows touch; the extended words are hashed.
   Within an anchor, stretches with equal extensions form a class: all but the earliest are repeats over their whole length.
3. Where an anchor has several classes, their earliest members may still share single windows; only for these the text is
   looked at again and windows are compared one by one in the same way.
4. The maximal union of repeated windows is cut out of each document.

Scan tasks compare the stretches they hold before sending them (``WINDOW_RUNS`` at a time), and send known repeats to partitions of
their own, so a passage in a third of all documents reaches its task a few times per scan task, sorted and streamed.
Anchors and extensions are told apart by two independent 64-bit hashes.

NULL text has no words.  A NULL doc_id sorts before all others.  Rows that repeat a doc_id count as one document whose texts are
compared by their starts; identical rows get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.base import Sender, as_batch, from_key, id_key, kept, query, table, text_bytes

LENGTH = 20
SEED = 6
# Words looked at together and stretches compared together inside a scan task.
BLOCK_WORDS = 500_000
WINDOW_RUNS = 600_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_RUN = pa.schema([("slot", pa.int64()), ("extent", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int32()),
                  ("more", pa.int32()), ("done", pa.bool_())])
_RUN_DDL = "slot long, extent long, doc long, twin long, start int, more int, done boolean"
_FOUND = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int32()), ("more", pa.int32()), ("ask", pa.bool_())])
_FOUND_DDL = "doc long, twin long, start int, more int, ask boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return (x ^ (x >> np.uint64(29))) * _STEP


class Hashes(dict):
    """Places of words in two arrays of independent 64-bit hashes."""

    def __init__(self):
        super().__init__()
        self.seen: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.seen)
        self.seen.append(word)
        return place

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in self.seen]), "<u8").reshape(-1, 2)
        out = raw[places, 0], raw[places, 1]
        self.clear()
        self.seen = []
        return out


class Rolling:
    """Hashes of word ranges from prefix sums; the factor is odd, so its powers can be undone."""

    def __init__(self, values: np.ndarray):
        power = np.full(len(values) + 1, _ODD)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        inverse = np.full(len(values) + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def anchors(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``SEED``-word run at each place; place of the leftmost least one of the ``window`` runs from each place on."""
    n = len(values)
    run = values.copy()
    for i in range(1, SEED):
        run[:n - i] = run[:n - i] * _STEP + values[i:]
    run = _mix(run)
    least, place, width = run.copy(), np.arange(n), 1
    while width < window:
        step = min(width, window - width)
        later = np.flatnonzero(least[step:] < least[:n - step])
        values_, places_ = least[later + step], place[later + step]
        least[later], place[later] = values_, places_
        width += step
    return run, place


def stretches(values: np.ndarray, other: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, extension hash, first window, further windows, document) of all stretches; ``ends``: document ends."""
    n = len(values)
    begins = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(ends)), ends - begins)
    whole = np.arange(n) + length <= ends[owner] if n else np.zeros(0, bool)
    run, place = anchors(values, length - SEED + 1)
    first = whole.copy()
    first[1:] &= ~(whole[:-1] & (place[1:] == place[:-1]) & (owner[1:] == owner[:-1]))
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    count = np.add.reduceat(whole.astype(np.int64), starts)
    more = count - 1
    rolled = Rolling(other)(starts, starts + more + length)
    extent = _mix(rolled ^ (more.astype(np.uint64) << np.uint64(40)) ^ ((place[starts] - starts).astype(np.uint64) << np.uint64(52)))
    return run[place[starts]], extent, starts - begins[owner[starts]], more, owner[starts]


class Runs:
    """Collects stretches and compares them among themselves before they are sent."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.count = 0

    def add(self, slot, extent, doc, twin, start, more) -> bool:
        self.parts.append((slot, extent, doc, twin, start, more))
        self.count += len(slot)
        return self.count >= WINDOW_RUNS

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        slot, extent, doc, twin, start, more = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.count = [], 0
        order = np.lexsort((start, doc, extent, slot))
        slot, extent, doc, twin, start, more = (c[order] for c in (slot, extent, doc, twin, start, more))
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (extent[1:] != extent[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))
        done = (doc != doc[lead]) | (start != start[lead])
        spread = _mix(doc.view(np.uint64) + _ODD * start.astype(np.uint64))
        slot = np.where(done, spread, slot)
        for a in range(0, len(slot), 100_000):
            b = a + 100_000
            yield as_batch(_RUN, slot[a:b].view(np.int64), extent[a:b].view(np.int64), doc[a:b], twin[a:b],
                           start[a:b].astype(np.int32), more[a:b].astype(np.int32), done[a:b])


def _seeds(length: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, hashes = Runs(), Hashes()
        words: list[bytes] = []
        ends, docs, twins = [], [], []

        def block() -> bool:
            nonlocal words, ends, docs, twins
            if not words:
                return False
            a, b = hashes.of(words)
            slot, extent, start, more, owner = stretches(a, b, np.array(ends, np.int64), length)
            full = runs.add(slot, extent, np.array(docs, np.int64)[owner], np.array(twins, np.int64)[owner], start, more)
            words, ends, docs, twins = [], [], [], []
            return full

        for batch in batches:
            for doc, twin, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = text.split()
                if len(found) < length:
                    continue
                words += found
                ends.append(len(words))
                docs.append(doc)
                twins.append(twin)
                if len(words) >= BLOCK_WORDS and block():
                    yield from runs.take()
        block()
        yield from runs.take()

    return seed


def _windows(length: int):
    """Single windows of the asked stretches, as stretches of one window."""
    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, hashes = Runs(), Hashes()
        for batch in batches:
            for doc, twin, text, starts, mores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = hashes.of(text.split())
                more = np.array(mores, np.int64)
                first = np.repeat(np.array(starts, np.int64), more + 1)
                first += np.arange(len(first)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                one, two = Rolling(a)(first, first + length), Rolling(b)(first, first + length)
                full = np.full(len(first), doc, np.int64), np.full(len(first), twin, np.int64)
                if runs.add(_mix(one), _mix(two), *full, first, np.zeros(len(first), np.int64)):
                    yield from runs.take()
        yield from runs.take()

    return window


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, done, extent, doc, start): what repeats an earlier class member, and which class leaders to ask about.

    A slot's only class so far is held back until the next row shows whether another follows.
    """
    slot = lead = None
    several = False
    held: list[tuple] = []
    for batch in batches:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        done = columns["done"]
        if done.any():
            part = {n: c[done] for n, c in columns.items()}
            yield as_batch(_FOUND, part["doc"], part["twin"], part["start"], part["more"], np.zeros(len(part["doc"]), bool))
            columns = {n: c[~done] for n, c in columns.items()}
        s, e, d, t, at, more = (columns[n] for n in ("slot", "extent", "doc", "twin", "start", "more"))
        if not len(s):
            continue
        n = len(s)
        same_slot, same_class = np.zeros(n, bool), np.zeros(n, bool)
        same_slot[1:] = s[1:] == s[:-1]
        same_class[1:] = same_slot[1:] & (e[1:] == e[:-1])
        same_slot[0] = s[0] == slot
        same_class[0] = same_slot[0] and lead is not None and e[0] == lead[0]
        leads = np.maximum.accumulate(np.where(same_class, -1, np.arange(n)))
        lead_doc, lead_at = (np.where(leads >= 0, c[leads], old) for c, old in
                             ((d, lead[1] if lead else 0), (at, lead[2] if lead else 0)))
        repeat = same_class & ((d != lead_doc) | (at != lead_at))
        yield as_batch(_FOUND, d[repeat], t[repeat], at[repeat], more[repeat], np.zeros(int(repeat.sum()), bool))
        # Classes of each slot in this batch, with what came before for the first slot.
        group = np.cumsum(~same_slot) - (0 if same_slot[0] else 1)
        classes = np.bincount(group, weights=~same_class, minlength=int(group[-1]) + 1)
        if same_slot[0]:
            classes[0] += 2 if several else 1
        many = classes >= 2
        if held and (not same_slot[0] or many[0]):
            if same_slot[0]:
                yield as_batch(_FOUND, *zip(*held, strict=True), [True] * len(held))
            held = []
        ask = ~repeat & many[group]
        yield as_batch(_FOUND, d[ask], t[ask], at[ask], more[ask], np.ones(int(ask.sum()), bool))
        if not many[-1]:
            keep = np.flatnonzero((group == group[-1]) & ~repeat)
            held += [(int(d[i]), int(t[i]), int(at[i]), int(more[i])) for i in keep]
            held = list(dict.fromkeys(held))
        slot, several = s[-1], bool(many[-1])
        lead = (e[-1], int(lead_doc[-1]), int(lead_at[-1]))


def _judged(runs: DataFrame) -> DataFrame:
    return (runs.repartition("slot").sortWithinPartitions("slot", "done", "extent", "doc", "start")
            .mapInArrow(_judge, _FOUND_DDL))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                  ("kept", pa.binary())])


def _cutter(length: int, texts: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(_OUT)
        for batch in batches:
            for doc, text, starts, mores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(starts) + np.array(mores) + length, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    kept = words
                line = b" ".join(kept)
                if send.add((doc, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line if texts else None),
                            len(line) if texts else 0):
                    yield send.take()
        yield send.take()

    return cut


def _lists(found: DataFrame) -> DataFrame:
    """Places to look at in each document; rows that repeat it ask for the same ones."""
    return (found.select("doc", "twin", "start", "more").distinct().groupBy("doc", "twin")
            .agg(F.collect_list("start").alias("starts"), F.collect_list("more").alias("mores")))


def cut_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text); with ``texts`` also the kept text."""
    keyed = docs.select(id_key().alias("doc"), F.xxhash64("text").alias("twin"), text_bytes().alias("text"))
    found = _judged(keyed.select("doc", "twin", "text").mapInArrow(_seeds(length), _RUN_DDL))
    found = kept(found, "repeats")
    asked = _lists(found.filter("ask"))
    windows = (keyed.join(asked, ["doc", "twin"]).select("doc", "twin", "text", "starts", "mores")
               .mapInArrow(_windows(length), _RUN_DDL))
    repeats = found.filter("NOT ask").unionByName(_judged(windows).filter("NOT ask")).drop("ask")
    out = (keyed.join(_lists(repeats), ["doc", "twin"], "left").select("doc", "text", "starts", "mores")
           .mapInArrow(_cutter(length, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
           .withColumn("doc_id", from_key(F.col("doc_id"))))
    return out.withColumn("kept", F.col("kept").cast("string")) if texts else out.drop("kept")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
