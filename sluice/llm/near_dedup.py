"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has ``PARTS`` components of 16 bits, the least values of as many hashes over its set of word shingles.  Two
signatures are close when at most ``distance`` components differ.  Components are split into chunks; by the pigeonhole principle a close pair
has a chunk with at most ``ERRORS`` differing components, so each chunk is enumerated with every choice of that many components left out,
and close pairs meet at one of these keys without exception.  ``distance`` lies ``SPREAD`` standard deviations above what pairs at the
similarity bound are expected to show.

1. Documents with equal sets form a class; only class representatives are joined.
2. Keys that one representative has alone are dropped in a sorted pass.
3. Pairs at a key are not enumerated.  Each key has a hub, the representative that shares most keys with others (the original among its copies,
   as a rule), and all who meet at the key join the hub's group.  So any close pair stands together in some group.
4. Within a group, members are reduced to their symmetric difference with the hub's set, short for near copies.  With
   i(x) the elements x has in common with hub c, two members have i(x) + i(y) - |c| + |D(x) & D(y)| in common: an inverted index over the
   differences gives that exactly for one member against all others.  Members linked to the hub need not be compared with
   each other.  A group of more than ``GROUP_CELLS`` elements is dealt into blocks and each pair of blocks is worked on apart.
   A group sends no more links than hold its components together.
5. Components over all links; membership is joined back.

NULL and blank texts have empty sets, are linked with nothing and stay.  A NULL doc_id sorts before all others.  A document is a doc_id with
one text: rows with one doc_id, or with none, and different texts are documents of their own, told apart by a hash of the text.  Of a component
the document with the smallest doc_id is kept, of several with that doc_id the one with the smallest text hash; rows that repeat it share its verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.base import Sender, as_batch, from_key, id_key, kept, query, table, text_bytes
from sluice.llm.components import components
from sluice.session import stored

PARTS = 64
ERRORS = 1
SPREAD = 5.0
# Elements of one block of a group, hub's copies included.
GROUP_CELLS = 3_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"factor%d" % i) | 1 for i in range(PARTS)], np.uint64)[:, None]
_OFFSETS = np.array([xxhash.xxh3_64_intdigest(b"offset%d" % i) for i in range(PARTS)], np.uint64)[:, None]


@dataclass(frozen=True)
class Rule:
    """Linked when ``share`` percent of the union is common; sets of ``words``-word shingles."""

    words: int
    share: int

    @property
    def chunks(self) -> int:
        miss = 1 - self.share / 100
        distance = math.ceil(PARTS * miss + SPREAD * math.sqrt(PARTS * miss * (1 - miss)))
        return distance // (ERRORS + 1) + 1

    @property
    def distance(self) -> int:
        """The largest distance that the chunks guarantee to find."""
        return self.chunks * (ERRORS + 1) - 1


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words make one shingle of them all."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i:i + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    least = np.full(PARTS, np.iinfo(np.uint64).max)
    for a in range(0, len(values), 4096):
        least = np.minimum(least, (values[None, a:a + 4096] * _FACTORS + _OFFSETS).min(axis=1))
    return ((least * _ODD) >> np.uint64(48)).astype("<u2")


_SIGNED = pa.schema([("doc", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("whole", pa.binary()), ("sig", pa.binary())])


def _sign(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(_SIGNED)
        for batch in batches:
            for doc, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = shingles(text, words)
                found = (xxhash.xxh3_128_digest(values.tobytes()), signature(values).tobytes()) if len(values) else (None, None)
                if send.add((doc, own, len(values), *found)):
                    yield send.take()
        yield send.take()

    return sign


_KEYED = pa.schema([("key", pa.int64()), ("rep", pa.int64())])


def _enumerate(chunks: int):
    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.array_split(np.arange(PARTS), chunks)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, PARTS).astype(np.uint64)
            reps = batch.column("rep").to_numpy()
            for number, chunk in enumerate(parts):
                for out in chunk:
                    key = np.full(len(sig), np.uint64(number * PARTS + out + 1)) * _ODD
                    for i in chunk:
                        if i != out:
                            key = (key ^ sig[:, i]) * _ODD
                            key ^= key >> np.uint64(31)
                    yield as_batch(_KEYED, key.view(np.int64), reps)

    return enumerate_


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key stands more than once; the last row of a batch waits for the next."""
    waiting, joined = None, False
    for batch in batches:
        keys, reps = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
        if not len(keys):
            continue
        if waiting is not None:
            keys, reps = np.concatenate([[waiting[0]], keys]), np.concatenate([[waiting[1]], reps])
        same = keys[1:] == keys[:-1]
        several = np.zeros(len(keys), bool)
        several[1:] |= same
        several[:-1] |= same
        several[0] |= waiting is not None and joined
        yield as_batch(_KEYED, keys[:-1][several[:-1]], reps[:-1][several[:-1]])
        joined = bool(several[-1])
        waiting = (keys[-1], reps[-1])
    if joined:
        yield as_batch(_KEYED, [waiting[0]], [waiting[1]])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Group:
    """A hub and members of its group, as differences to the hub's set."""

    def __init__(self, rule: Rule, hub: int, values: np.ndarray):
        self.rule, self.names, self.hub = rule, [hub], values
        self.common, self.sizes, self.parts = [len(values)], [len(values)], [np.zeros(0, np.uint64)]

    def add(self, name: int, values: np.ndarray) -> None:
        self.names.append(name)
        self.common.append(len(np.intersect1d(self.hub, values, assume_unique=True)))
        self.sizes.append(len(values))
        self.parts.append(np.setxor1d(self.hub, values, assume_unique=True))

    def links(self) -> list[tuple[int, int]]:
        """Links that hold the components of this group together."""
        common, sizes = np.array(self.common), np.array(self.sizes)
        parent = list(range(len(common)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        near = self._linked(common, sizes, sizes[0])
        for other in np.flatnonzero(near)[1:]:
            parent[other] = 0
            out.append((self.names[0], self.names[other]))
        alone = np.flatnonzero(~near)
        if not len(alone):
            return out
        lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        flat = np.concatenate(self.parts)
        order = np.argsort(flat, kind="stable")
        member, flat = np.repeat(np.arange(len(lengths)), lengths)[order], flat[order]
        for x in alone:
            first, last = np.searchsorted(flat, self.parts[x], "left"), np.searchsorted(flat, self.parts[x], "right")
            count = last - first
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            shared = np.bincount(member[at], minlength=len(common))
            for y in np.flatnonzero(self._linked(common[x] + common - common[0] + shared, sizes, sizes[x])):
                one, two = find(int(x)), find(int(y))
                if one != two:
                    parent[max(one, two)] = min(one, two)
                    out.append((self.names[x], self.names[y]))
        return out

    def _linked(self, common: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
        return 100 * common >= self.rule.share * (sizes + size - common)


def _confirm(rule: Rule):
    """Rows sorted by (hub, one, two, own): the hub's text first, then those of its members."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(_LINK)
        at, group = None, None
        for batch in batches:
            for hub, one, two, _, rep, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = shingles(text, rule.words)
                if (hub, one, two) == at:
                    group.add(rep, values)
                    continue
                for link in group.links() if group else ():
                    if send.add(link):
                        yield send.take()
                at, group = (hub, one, two), Group(rule, rep, values)
        for link in group.links() if group else ():
            if send.add(link):
                yield send.take()
        yield send.take()

    return confirm


def _links(star: DataFrame, sizes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Confirmed links within the groups of ``star`` (hub, rep); ``sizes``: rep, n."""
    counted = star.join(sizes, "rep").groupBy("hub").agg(F.sum("n").alias("cells"), F.count("*").alias("members"))
    blocks = counted.join(sizes, F.col("hub") == F.col("rep")).select(
        "hub", F.ceil((F.col("cells") + F.col("members") * F.col("n")) / GROUP_CELLS).cast("int").alias("blocks"))
    dealt = star.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = dealt.select("hub", "rep", "block", other).select(
        "hub", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), F.lit(1).alias("own"), "rep")
    pairs = blocks.withColumn("one", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hubs = pairs.select("hub", "one", F.explode(F.sequence("one", F.col("blocks") - 1)).alias("two"), F.lit(0).alias("own"), F.col("hub").alias("rep"))
    rows = members.unionByName(hubs).join(texts, "rep").select("hub", "one", "two", "own", "rep", "text")
    return (rows.repartition("hub", "one", "two").sortWithinPartitions("hub", "one", "two", "own", "rep")
            .mapInArrow(_confirm(rule), "a long, b long"))


def _judged(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc (``id_key``), own (hash of the text), n, component, kept and class (smallest doc of component and class) for every row of ``docs``."""
    keyed = docs.select(id_key().alias("doc"), F.xxhash64("text").alias("own"), text_bytes().alias("text"))
    signed = kept(keyed.mapInArrow(_sign(rule.words), "doc long, own long, n long, whole binary, sig binary"), "signatures")
    found = signed.filter("n > 0").groupBy("whole").agg(F.min(F.struct("doc", "own")).alias("first"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    # Numbers of classes; they are fixed by being written.
    classes = kept(found.select(F.monotonically_increasing_id().alias("rep"), "whole", "first", "sig", "n"), "classes")
    met = kept(classes.select("rep", "sig").mapInArrow(_enumerate(rule.chunks), "key long, rep long").repartition("key")
               .sortWithinPartitions("key").mapInArrow(_shared, "key long, rep long"), "keys").distinct()
    sizes = stored(classes.select("rep", "first", "n").join(met.select("rep").distinct(), "rep", "left_semi"))
    asked = sizes.select("rep", F.col("first.doc").alias("doc"), F.col("first.own").alias("own"))
    texts = kept(keyed.join(asked, ["doc", "own"]).groupBy("rep").agg(F.min("text").alias("text")), "texts")
    many = met.groupBy("key").agg(F.count("*").alias("size"))
    rank = met.join(many, "key").groupBy("rep").agg(F.sum("size").alias("shared"))
    hub = met.join(rank, "rep").groupBy("key").agg(F.min(F.struct(-F.col("shared"), "rep")).getField("rep").alias("hub"))
    star = stored(met.join(hub, "key").filter("rep <> hub").select("hub", "rep").distinct())
    label = components(_links(star, sizes.select("rep", "n"), texts, rule))
    linked = classes.select("rep", "first").join(label, F.col("rep") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    of_rep = linked.select("rep", "component").join(least, "component").select(F.col("rep").alias("node"), "least")
    of_class = (classes.select("whole", "rep", "first").join(of_rep, F.col("rep") == F.col("node"), "left")
                .select("whole", F.col("first.doc").alias("class"), F.coalesce("least", "first").alias("least")))
    out = signed.select("doc", "own", "n", "whole").join(of_class, "whole", "left")
    return out.select("doc", "own", "n", F.coalesce("least.doc", "doc").alias("component"),
                      F.coalesce(F.col("least") == F.struct("doc", "own"), F.lit(True)).alias("kept"), F.coalesce("class", "doc").alias("class"))


def near_groups(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (the smallest doc_id with an equal set) for every row of ``docs`` (doc_id, text)."""
    return _judged(docs, rule).select(from_key(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"),
                                      from_key(F.col("component")).alias("component_id"), "kept", from_key(F.col("class")).alias("class_id"))


OP3 = Rule(words=3, share=85)
# The usual rule of the pipeline.
STAGE = Rule(words=5, share=80)


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kept`` is the contract's column, by doc_id alone; ``chosen`` is the one of several texts under a doc_id that stays."""
    found = near_groups(table(spark, sf_dir, "documents"), OP3).withColumnRenamed("kept", "chosen")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, rule: Rule = STAGE) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns; of rows that repeat it one stays.

    Documents without words are linked with nothing and stay.
    """
    found = _judged(docs, rule).filter("n > 0").groupBy("doc", "own").agg(F.min("kept").alias("kept"), F.count("*").alias("rows"))
    # Documents that go, and those that stay but stand in several rows.
    marks = kept(found.filter("NOT kept OR rows > 1").select(F.col("doc").alias("_doc"), F.col("own").alias("_own"), "kept"), "copies")
    keyed = docs.withColumn("_key", id_key()).withColumn("_hash", F.xxhash64("text"))
    same = (F.col("_key") == F.col("_doc")) & (F.col("_hash") == F.col("_own"))
    out = keyed.join(marks, same, "left_anti")
    several = marks.filter("kept")
    if not several.isEmpty():
        out = out.unionByName(keyed.join(several, same, "left_semi").dropDuplicates(["_key", "_hash"]))
    return out.select(*docs.columns)
