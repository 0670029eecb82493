"""Prefix trie of conversations from vertical bitmaps.

A node is a distinct sequence of leading turns; its members are the conversations that begin with it.

1. A turn becomes a 128-bit digest of (role, text) and its number of code points; texts stay where they are.
2. Turns are range-partitioned by the conversation whose head they may share and sorted, so that a task meets
   conversations whole and in order.  They are taken in blocks of a bounded number of turns (``BLOCK_TURNS``).
3. A block indexes (position, turn) to the bitset of its conversations that have this turn there.  Depth-first from the root, the
   bitset of a node is cut with the postings of the next position: the parts are the children, their popcounts the members, and the
   bitset of conversations of just this length gives the list of those that end there.
4. The nodes of all blocks meet by a digest of their path.  A node that very many conversations share has one row per block.
5. Leaves and saved tokens of subtrees: nodes with a single member need none of it.  The others add, in round j, what the nodes 2^j below
   them hold; the number of rounds is logarithmic in the depth.

Order of turns: by ``turn``, NULL first, ties by the digest.  NULL role or text is empty.  Rows without conv_id take no part.  Repeated
rows are turns of their own.  No conversations: no nodes, not even a root.  ``conv_id % every`` has the sign of conv_id, as in SQL.
A conversation passes one task, in order; beyond ``LONG_TURNS`` turns it is streamed, with 16 bytes kept per turn.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.base import Sender, kept, query, rows, table
from sluice.session import stored

# Conversations and turns of a block: the width of a bitset and the number of postings held at once.
BLOCK_CONVERSATIONS = 4096
BLOCK_TURNS = 65_536
# Turns of one conversation that go into a block's bitmaps.
LONG_TURNS = 16_384
# A parent with more children than this, and with more than this share of all nodes, is looked up in a broadcast table.
HEAVY_CHILDREN = 1000
HEAVY_PARENTS = 10_000

WIDTH = 16
ROOT = bytes(WIDTH)

_PART = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("low", pa.int64()),
                   ("n", pa.int64()), ("child", pa.int64()), ("up", pa.list_(pa.binary())), ("ends", pa.string())])
_PART_DDL = "node binary, parent binary, depth long, chars long, low long, n long, child long, up array<binary>, ends string"


def _below(path: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(path + turn, digest_size=WIDTH).digest()


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def _runs(ids: list[int]) -> Iterator[list[int]]:
    """Ascending runs that do not cross zero; the runs of all blocks never overlap."""
    run: list[int] = []
    for i in ids:
        if run and (i < run[-1] or (i < 0) != (run[-1] < 0)):
            yield run
            run = []
        run.append(i)
    if run:
        yield run


class _Trail:
    """Paths from the root to the present node, ``WIDTH`` bytes each."""

    def __init__(self):
        self.held = bytearray(ROOT)

    def at(self, depth: int) -> bytes:
        return bytes(self.held[depth * WIDTH:(depth + 1) * WIDTH])

    def put(self, depth: int, path: bytes) -> None:
        self.held[depth * WIDTH:] = path

    def up(self, depth: int) -> list[bytes]:
        """Ancestors 1, 2, 4 ... levels above ``depth``."""
        return [self.at(depth - (1 << j)) for j in range(depth.bit_length())] if depth else []


class _Block:
    """Postings of some conversations and the depth-first walk over them."""

    def __init__(self, width: int):
        self.width = width
        self.ids: list[int] = []
        self.turns: list[list[tuple[bytes, int]]] = []
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ending: dict[int, int] = {}
        self.size = 0
        self.ascending = True

    def add(self, conv_id: int, turns: list[tuple[bytes, int]], ended: bool) -> None:
        bit = 1 << len(self.ids)
        self.ascending = self.ascending and (not self.ids or conv_id > self.ids[-1])
        self.ids.append(conv_id)
        self.turns.append(turns)
        self.size += len(turns) + 1
        for position, (turn, _) in enumerate(turns):
            key = (position, turn)
            self.postings[key] = self.postings.get(key, 0) | bit
        if ended:
            self.ending[len(turns)] = self.ending.get(len(turns), 0) | bit

    def full(self) -> bool:
        return len(self.ids) >= self.width or self.size >= BLOCK_TURNS

    def walk(self, trail: _Trail) -> Iterator[tuple]:
        """Rows of all nodes; afterwards ``trail`` leads to the last node of the last conversation."""
        last = len(self.ids) - 1
        stack = [((1 << len(self.ids)) - 1, 0, ROOT, 0)]
        leads: bytearray | None = None
        while stack:
            bitset, depth, path, chars = stack.pop()
            trail.put(depth, path)
            ends = bitset & self.ending.get(depth, 0)
            rest = bitset ^ ends
            low = self.ids[(bitset & -bitset).bit_length() - 1] if self.ascending else min(self.ids[i] for i in _bits(bitset))
            yield (path, trail.at(depth - 1) if depth else None, depth, chars, low, bitset.bit_count(), int(rest > 0), trail.up(depth), None)
            for run in _runs([self.ids[i] for i in _bits(ends)]):
                yield (path, None, None, None, run[0], None, None, None, ",".join(map(str, run)))
            if bitset >> last and len(self.turns[last]) == depth:
                leads = bytearray(trail.held)
            while rest:
                first = (rest & -rest).bit_length() - 1
                if len(self.turns[first]) == depth:  # goes on after this block
                    rest ^= 1 << first
                    continue
                turn, size = self.turns[first][depth]
                child = rest & self.postings[depth, turn]
                rest ^= child
                stack.append((child, depth + 1, _below(path, turn), size))
        trail.held = leads


def _tries(heads: int, width: int, long_turns: int):
    """Rows (base, conv_id, turn digest, code points) in order to the nodes of blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(_PART)
        block, trail = _Block(width), _Trail()
        base = conv = None
        head: list[tuple[bytes, int]] = []
        turns: list[tuple[bytes, int]] = []
        skip = seen = 0
        tail: tuple | None = None  # the node of a long conversation that waits for its successor

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if block.ids:
                for row in block.walk(trail):
                    if send.add(row, 200):
                        yield send.take()
            block = _Block(width)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal tail
            if tail is not None:
                path, parent, depth, size, up = tail
                send.add((path, parent, depth, size, conv, 1, 0, up, None))
                if send.add((path, None, None, None, conv, None, None, None, str(conv))):
                    yield send.take()
                tail = None
            elif conv is not None:
                block.add(conv, turns, True)
                if block.full():
                    yield from flush()

        for row_base, row_conv, turn, size in rows(batches):
            if row_conv != conv:
                yield from finish()
                if row_base != base:
                    base, head = row_base, []
                conv, seen = row_conv, 0
                skip = zlib.crc32(str(conv).encode()) % heads if heads and conv != base else 0
                turns = list(head[:skip])
            seen += 1
            if heads and conv == base and seen < heads:
                head.append((turn, size))
            if seen <= skip:
                continue
            if tail is not None:
                path, parent, depth, chars, up = tail
                if send.add((path, parent, depth, chars, conv, 1, 1, up, None), 200):
                    yield send.take()
            elif len(turns) < long_turns:
                turns.append((turn, size))
                continue
            else:
                block.add(conv, turns, False)
                yield from flush()
                depth = len(turns)
            path = _below(trail.at(depth), turn)
            trail.put(depth + 1, path)
            tail = (path, trail.at(depth), depth + 1, size, trail.up(depth + 1))
        yield from finish()
        yield from flush()
        yield send.take()

    return build


def local_tries(conversations: DataFrame, every: int = 1, heads: int = 0, width: int = BLOCK_CONVERSATIONS, long_turns: int = LONG_TURNS) -> DataFrame:
    """Nodes and end lists of all blocks, written to the shared folder.

    ``conversations``: conv_id, turn, role, text.  With ``heads`` > 0 a conversation c takes the first crc32(c) % heads turns from
    conversation c - c % every instead of its own.  ``width``: conversations of a block.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("bigint")
    base = conv - conv % F.lit(every)
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, WIDTH)
    turns = conversations.filter(conv.isNotNull()).select(
        base.alias("base"), conv.alias("conv"), F.col("turn").alias("turn"), digest.alias("key"), F.length(text).cast("bigint").alias("chars"))
    order = ["base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "key"]
    return kept(turns.repartitionByRange("base").sortWithinPartitions(*order).select("base", "conv", "key", "chars")
                .mapInArrow(_tries(heads, width, max(long_turns, heads)), _PART_DDL), "tries")


def end_lists(tries: DataFrame) -> DataFrame:
    """node, first, ends: conv_ids that end at a node, ascending and comma-joined, in pieces that follow each other by ``first``."""
    return tries.filter(F.col("ends").isNotNull()).select("node", F.col("low").alias("first"), "ends")


def trie_nodes(tries: DataFrame) -> DataFrame:
    """node, parent, depth, chars, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens of the whole trie."""
    nodes = kept(tries.filter(F.col("n").isNotNull()).groupBy("node").agg(
        F.first("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.min("low").alias("conv_id"),
        F.sum("n").alias("n_convs"), F.max("child").alias("child"), F.first("up").alias("up")), "nodes")
    shared_only = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    below = nodes.filter("depth > 0").groupBy(F.col("parent").alias("of")).agg(
        F.count("*").alias("children"), F.sum((F.col("n_convs") == 1).cast("bigint")).alias("single"))
    children = F.coalesce("children", F.lit(0))
    shared = stored(nodes.filter(shared_only).join(below, F.col("node") == F.col("of"), "left").select(
        "node", "up", "conv_id", children.alias("n_children"),
        (F.coalesce("single", F.lit(0)) + (children == 0).cast("bigint")).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
    rounds = shared.agg(F.max(F.size("up"))).first()[0] or 0
    for j in range(rounds):
        sums = shared.filter(F.size("up") > j).groupBy(F.col("up")[j].alias("of")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        shared = stored(shared.join(sums, F.col("node") == F.col("of"), "left").select(
            "node", "up", "conv_id", "n_children", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")))

    # At most HEAVY_PARENTS nodes have more than this many children.
    most = max(HEAVY_CHILDREN, nodes.count() // HEAVY_PARENTS)
    heavy = shared.filter(F.col("n_children") > most).select(F.col("node").alias("hot"), F.col("conv_id").alias("hot_conv"))
    light = shared.filter(F.col("n_children") <= most).select(F.col("node").alias("cool"), F.col("conv_id").alias("cool_conv"))
    own = shared.select(F.col("node").alias("_n"), F.col("n_children").alias("_c"), F.col("n_leaves").alias("_l"), F.col("saved_tokens").alias("_s"))
    # Children of heavy parents are dealt by their own digest, which no condition accepts.
    dealt = F.when(F.col("hot").isNull() & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("node"))
    return (nodes.join(F.broadcast(heavy), F.col("parent") == F.col("hot"), "left")
            .join(light, (dealt == F.col("cool")) & F.col("hot").isNull() & F.col("parent").isNotNull(), "left")
            .join(own, F.col("node") == F.col("_n"), "left")
            .select("node", "parent", "depth", "chars", "conv_id",
                    F.when(F.col("depth") > 0, F.coalesce("hot_conv", "cool_conv", "conv_id")).alias("parent_conv_id"), "n_convs",
                    F.coalesce("_c", "child").alias("n_children"), F.coalesce("_l", F.lit(1)).cast("bigint").alias("n_leaves"),
                    F.coalesce("_s", F.lit(0)).cast("bigint").alias("saved_tokens")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.binary()), ("sha", pa.string())])
    send = Sender(schema)
    node, digest = None, hashlib.sha256()
    for of, ends in rows(batches):
        if of == node:
            digest.update(b"," + ends.encode())
            continue
        if node is not None and send.add((node, digest.hexdigest())):
            yield send.take()
        node, digest = of, hashlib.sha256(ends.encode())
    if node is not None:
        send.add((node, digest.hexdigest()))
    yield send.take()


def list_digests(ends: DataFrame) -> DataFrame:
    """node, sha: SHA-256 of a node's whole end list; its pieces are read in order, none is held."""
    return (ends.repartition("node").sortWithinPartitions("node", "first").select("node", "ends")
            .mapInArrow(_hashed, "node binary, sha string"))


SQL = r"""
WITH RECURSIVE h AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
head AS (
  SELECT h.conv_id, o.pos AS k, o.role, o.text FROM h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100 WHERE o.pos <= h.h),
taken AS (SELECT conv_id, count(*) AS n FROM head GROUP BY conv_id),
rebuilt AS (
  SELECT * FROM head
  UNION ALL
  SELECT o.conv_id, o.pos - h.h + coalesce(t.n, 0), o.role, o.text
  FROM own o JOIN h USING (conv_id) LEFT JOIN taken t USING (conv_id) WHERE o.pos > h.h),
listed AS (
  SELECT h.conv_id, count(r.k) AS depth, coalesce(list(sha256(length(r.role) || ':' || r.role || r.text) ORDER BY r.k) FILTER (r.k IS NOT NULL), []) AS turns
  FROM h LEFT JOIN rebuilt r USING (conv_id) GROUP BY h.conv_id),
steps AS (
  SELECT l.conv_id, d.d AS d, sha256(array_to_string(list_slice(l.turns, 1, d.d), ',')) AS path, d.d = l.depth AS ends,
         CASE WHEN d.d = 0 THEN 0 ELSE length(r.text) END AS chars
  FROM listed l JOIN (SELECT unnest(generate_series(0, (SELECT max(depth) FROM listed))) AS d) d ON d.d <= l.depth
  LEFT JOIN rebuilt r ON r.conv_id = l.conv_id AND r.k = d.d),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY path, d),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS parent
  FROM nodes n LEFT JOIN steps s ON s.conv_id = n.conv_id AND s.d = n.d - 1 LEFT JOIN nodes p ON p.path = s.path AND p.d = s.d),
counted AS (
  SELECT l.*, coalesce(c.n, 0) AS n_children
  FROM linked l LEFT JOIN (SELECT parent, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY parent) c ON c.parent = l.path),
sums AS (
  SELECT s.path, s.d, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM counted n JOIN steps s ON s.conv_id = n.conv_id AND s.d <= n.d GROUP BY s.path, s.d)
SELECT c.conv_id, c.d AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.path = c.path AND s.d = c.d
"""


@query("op11_prefix_trie", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = local_tries(table(spark, sf_dir, "conversations"), every=100, heads=6)
    hashed = list_digests(end_lists(tries)).withColumnRenamed("node", "_of")
    return trie_nodes(tries).join(hashed, F.col("node") == F.col("_of"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
