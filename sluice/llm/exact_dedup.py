"""Exact de-duplication over an extendible-hash index in shared files.

Texts are equal when they are identical after each run of ASCII white space becomes one space.

1. Scan tasks normalise texts and chain equal ones they meet within a window of memory (bytes
   are compared by the dictionary).  Each chain sends its text once; this is what keeps a text
   that a third of all rows share from becoming a third of the shuffle.
2. The entries are written to the shared folder.  A directory over the leading hash bits is
   doubled wherever a bucket holds more than its share of bytes; a bucket that more bits cannot
   split (one hash value) stays as it is and is chained.
3. Owner tasks take buckets, walk them in hash order, chain what collides and compare bytes within a
   chain.  A hash value with very many chains goes through several owners first, each of which
   merges a share of them.
4. Every document learns the outcome of its chain by a narrow join.  ``drop_copies`` needs no join: its chains
   carry the row that stays with all its columns, so that texts are shuffled once.

NULL text counts as empty; a NULL doc_id loses against any other id.  Rows that repeat both
doc_id and text are the same document: each comes back, with the same figures; ``drop_copies`` keeps one, and of rows
that differ in white space only the one whose text sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.base import BLANKS, Sender, kept, query, rows, slices, table, text_bytes
from sluice.session import scratch_path, shuffle_partitions, stored

# Text bytes a scan task holds for chaining before it starts afresh.
WINDOW_BYTES = 16 << 20
# Text bytes of a bucket before the directory is doubled.
BUCKET_BYTES = 32 << 20
# Doublings of an overfull bucket at a time.
BITS = 4
# Chains of one hash value that an owner takes at once.
MERGE = 64
# Hash values with more chains than that are found by a broadcast table up to this number, else by a shuffle.
HOT_HASHES = 100_000

_ENTRY = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("h", pa.int64()), ("uid", pa.int64()),
                    ("lead", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_GROUP = pa.schema([("lead", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("onto", pa.int64()), ("h", pa.int64()),
                    ("body", pa.binary())])
_GROUP_DDL = "lead long, keep_id long, group_size long, onto long, h long, body binary"


def normalised(text: bytes) -> bytes:
    """``text`` with each run of ASCII white space replaced by one space."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    middle = b" ".join(words)
    return b" " * (text[0] in BLANKS) + middle + b" " * (text[-1] in BLANKS)


def _lower(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _chain_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; the first of each chain carries the text and the chain's figures."""
    base = TaskContext.get().partitionId() << 33
    uid = 0
    send = Sender(_ENTRY)
    chains: dict[bytes, list] = {}
    members: list[tuple] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal chains, members, held
        for text, (lead, low, n, sha, h, first) in chains.items():
            if send.add((first, sha, h, lead, lead, low, n, text), len(text)):
                yield send.take()
        for doc_id, chain, own in members:
            if send.add((doc_id, chain[3], chain[4], own, chain[0], None, None, None)):
                yield send.take()
        yield send.take()
        chains, members, held = {}, [], 0

    for doc_id, text in rows(batches):
        text = normalised(text)
        own = base + uid
        uid += 1
        chain = chains.get(text)
        if chain is None:
            digest = hashlib.sha256(text)
            chains[text] = [own, doc_id, 1, digest.hexdigest(), _hash(digest.digest()), doc_id]
            held += len(text) + 200
        else:
            chain[1] = _lower(chain[1], doc_id)
            chain[2] += 1
            members.append((doc_id, chain, own))
            held += 60
        if held >= WINDOW_BYTES:
            yield from flush()
    yield from flush()


def _own(batches: Iterator[pa.RecordBatch], bodies: bool = False) -> Iterator[pa.RecordBatch]:
    """Walk buckets in hash order; the chains of one hash value are told apart by their bytes.

    A row per chain that came in (``lead``) with the figures of the whole and the first of its chains (``onto``), which has
    the text again where ``bodies`` are wanted.
    """
    send = Sender(_GROUP)
    current, chains = None, []

    def close() -> Iterator[pa.RecordBatch]:
        for body, low, n, leads in chains:
            for lead in leads:
                said = body if bodies and lead == leads[0] else None
                if send.add((lead, low, n, leads[0], current, said), len(said or b"")):
                    yield send.take()

    for h, lead, low, n, body in rows(batches):
        if h != current:
            yield from close()
            current, chains = h, []
        for chain in chains:
            if chain[0] == body:
                chain[1] = _lower(chain[1], low)
                chain[2] += n
                chain[3].append(lead)
                break
        else:
            chains.append([body, low, n, [lead]])
    yield from close()
    yield send.take()


def directory(entries: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """(bits, prefix, size) of the buckets: each hash value has its ``bits`` leading bits as prefix in just one of them.

    ``entries``: h and size.  The first directory has a bucket per half ``capacity``; overfull buckets are doubled ``BITS`` times
    per pass over the narrow entries, until they are not or hold one hash value.  Only totals come to the driver.
    """
    total = entries.agg(F.sum("size")).first()[0] or 0
    bits = min(62, max(1, (2 * total // capacity).bit_length()))
    left, done = entries, None
    while True:
        sizes = stored(left.groupBy(F.shiftright("h", 64 - bits).alias("prefix")).agg(
            F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("single")))
        full = (F.col("size") > capacity) & ~F.col("single") & F.lit(bits < 62)
        level = sizes.filter(~full).select(F.lit(bits).alias("bits"), "prefix", "size")
        done = level if done is None else done.unionByName(level)
        if sizes.filter(full).isEmpty():
            return done
        left = left.join(sizes.filter(full).select("prefix"), F.shiftright("h", 64 - bits) == F.col("prefix"), "left_semi")
        bits = min(62, bits + BITS)


def _small(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, marked for a broadcast where it has few rows, and its number of rows."""
    n = df.count()
    return (F.broadcast(df) if n <= HOT_HASHES else df), n


def _owned(chains: DataFrame, buckets: DataFrame) -> DataFrame:
    """``chains`` in owner tasks, whole buckets in each, sorted by hash."""
    # Depths of the directory: a handful, as hashes are spread evenly.
    depths = sorted(r["bits"] for r in buckets.select("bits").distinct().collect()) or [1]
    columns = chains.columns
    owners = max(shuffle_partitions(chains.sparkSession), buckets.count())
    key, at = F.shiftright("h", 64 - depths[0]), F.lit(depths[0])
    for above, bits in zip(depths, depths[1:]):
        # Rows whose bucket of the depth above was doubled.
        doubled, _ = _small(buckets.filter(F.col("bits") >= bits).select(
            F.expr(f"shiftright(prefix, bits - {above})").alias("_p"), F.lit(True).alias(f"_deep{bits}")).distinct())
        chains = chains.join(doubled, F.shiftright("h", 64 - above) == F.col("_p"), "left").drop("_p")
        key = F.when(F.col(f"_deep{bits}"), F.shiftright("h", 64 - bits)).otherwise(key)
        at = F.when(F.col(f"_deep{bits}"), F.lit(bits)).otherwise(at)
    return chains.repartition(owners, at, key).select(*columns).sortWithinPartitions("h")


def _hot(chains: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Chains of hash values with more than ``MERGE`` of them (and ``salts``: how many owners share these), and all others."""
    counts, n = _small(stored(chains.groupBy(F.col("h").alias("_h")).agg(F.ceil(F.count("*") / MERGE).cast("int").alias("salts"))
                              .filter("salts > 1")))
    if not n:
        return None
    same = F.col("h") == F.col("_h")
    return chains.join(counts, same).drop("_h"), chains.join(counts, same, "left_anti")


def _resolved(chains: DataFrame, capacity: int) -> DataFrame:
    """lead, keep_id, group_size of every chain (h, lead, low, n, body)."""
    hot = _hot(chains)
    calm = chains if hot is None else hot[1]
    found = _owned(calm, directory(calm.select("h", F.octet_length("body").cast("bigint").alias("size")), capacity)).mapInArrow(_own, _GROUP_DDL)
    groups = stored(found.select("lead", "keep_id", "group_size"))
    if hot is None:
        return groups
    owners = shuffle_partitions(chains.sparkSession)
    merged = kept(hot[0].repartition(owners, F.col("h"), F.pmod(F.xxhash64("lead"), F.col("salts"))).select("h", "lead", "low", "n", "body")
                  .sortWithinPartitions("h", "lead").mapInArrow(partial(_own, bodies=True), _GROUP_DDL), "merged-chains")
    above = _resolved(merged.filter(F.col("lead") == F.col("onto")).select(
        "h", "lead", F.col("keep_id").alias("low"), F.col("group_size").alias("n"), "body"), capacity).withColumnRenamed("lead", "_lead")
    return groups.unionByName(merged.select("lead", "onto").join(above, F.col("onto") == F.col("_lead")).select("lead", "keep_id", "group_size"))


def exact_groups(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "exact-dedup")
    (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
     .mapInArrow(_chain_locally, "doc_id long, sha string, h long, uid long, lead long, low long, n long, body binary")
     .write.parquet(path))
    entries = spark.read.parquet(path)
    groups = _resolved(entries.filter(F.col("uid") == F.col("lead")).select("h", "lead", "low", "n", "body"), capacity)
    return entries.select("doc_id", "sha", "lead").join(groups, "lead").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


class _Firsts:
    """Of equal texts the row that stays; rows are held as Arrow slices, with ``h`` behind the documents' columns."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.count = self.held = 0
        # Normalised text: order of the best row, its number, hash.
        self.best: dict[bytes, tuple[tuple, int, int]] = {}

    def add(self, part: pa.Table, known: list[int] | None) -> None:
        ids = part.column("doc_id").to_pylist()
        for i, (doc_id, text) in enumerate(zip(ids, part.column("text").cast(pa.binary()).to_pylist(), strict=True)):
            text = text or b""
            self.held += len(text) + 200
            plain = normalised(text)
            order = (doc_id is None, doc_id or 0, text)
            old = self.best.get(plain)
            if old is None:
                self.best[plain] = (order, self.count + i, known[i] if known else _hash(hashlib.sha256(plain).digest()))
            elif order < old[0]:
                self.best[plain] = (order, self.count + i, old[2])
        self.parts.append(part)
        self.count += part.num_rows

    def take(self) -> tuple[pa.Table, list[int]]:
        """The rows that stay and their hashes, in the order they came."""
        chosen = sorted((at, h) for _, at, h in self.best.values())
        out = pa.concat_tables(self.parts).take(pa.array([at for at, _ in chosen], pa.int64()))
        self.__init__()
        return out, [h for _, h in chosen]


def _sent(out: pa.Table, hashes: list[int], schema: pa.Schema, first: int) -> Iterator[pa.RecordBatch]:
    out = out.append_column("h", pa.array(hashes, pa.int64())).append_column("lead", pa.array(range(first, first + len(hashes)), pa.int64()))
    yield from pa.table(out.columns, names=out.column_names).cast(pa.schema(schema)).combine_chunks().to_batches(max_chunksize=512)


def _first_rows(batches: Iterator[pa.RecordBatch], known: bool) -> Iterator[pa.RecordBatch]:
    """Rows that stay within windows of ``WINDOW_BYTES``.  With ``known`` hashes rows come sorted by them, and a hash value is never cut."""
    base = TaskContext.get().partitionId() << 33
    held = _Firsts()
    sent = 0
    schema = None

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal sent
        if not held.count:
            return
        out, hashes = held.take()
        end = len(hashes)
        if known and not last:
            while end and hashes[end - 1] == hashes[-1]:
                end -= 1
            held.add(out.slice(end), hashes[end:])
        yield from _sent(out.slice(0, end), hashes[:end], schema, base + sent)
        sent += end

    for batch in slices(batches, 512):
        n = batch.num_columns - 2
        schema = schema or batch.schema
        part = pa.Table.from_arrays(batch.columns[:n], names=batch.schema.names[:n])
        held.add(part, batch.column(n).to_pylist() if known else None)
        if held.held >= WINDOW_BYTES:
            yield from flush(False)
    yield from flush(True)


def _firsts(chains: DataFrame, capacity: int) -> DataFrame:
    """Of chains of equal texts the row that stays."""
    hot = _hot(chains)
    calm = chains if hot is None else hot[1]
    sizes = calm.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    first = _owned(calm, directory(sizes, capacity)).mapInArrow(partial(_first_rows, known=True), chains.schema)
    if hot is None:
        return first
    shared = hot[0].repartition(shuffle_partitions(chains.sparkSession), F.col("h"), F.pmod(F.xxhash64("lead"), F.col("salts")))
    merged = kept(shared.select(*chains.columns).sortWithinPartitions("h").mapInArrow(partial(_first_rows, known=True), chains.schema), "merged-copies")
    return first.unionByName(_firsts(merged, capacity))


def drop_copies(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; of identical rows one stays."""
    numbered = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)])
    wide = numbered.withColumns({"h": F.lit(0).cast("bigint"), "lead": F.lit(0).cast("bigint")})
    chains = kept(wide.mapInArrow(partial(_first_rows, known=False), wide.schema), "copies")
    return _firsts(chains, capacity).select(*numbered.columns).toDF(*docs.columns)


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
s AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op8_exact_dedup", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
