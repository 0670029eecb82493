"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Only documents longer than a sequence are cut, into whole sequences and a rest.  Pieces are placed by falling size classes.
A round of a class works on its unplaced pieces and on the gaps that can hold some of them:

1. Pieces and gaps are range-sorted together by falling size, gaps first where sizes are equal.  A gap with room for
   several of the class's largest pieces offers that many equal slots.
2. Sweep: a slot's successor in this order is the largest piece that fits it, known from the number of pieces sorted before it.  Tasks
   sweep their ranges alone; what the ranges before them hold is added from a table with one row per task.
3. Conflicts: slots with the same successor take the pieces that follow, by rank.  With p(j) pieces before slot j the piece of slot j is
   j + max over i <= j of (p(i) - i), a running maximum.
4. Slots meet their pieces in a join on the piece's rank, gaps shrink, and the round is repeated until hardly anything fits
   (less than one in ``LAST`` of what is left).

What is left of a class opens sequences, as many pieces to each as are sure to fit; their rests are gaps of the classes below.

NULL text is empty: one piece, the end id alone.  Rows that repeat a doc_id are documents of their own (``row`` tells them apart).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.llm.base import Sender, kept, query, rows, table, text_bytes
from sluice.llm.tokens import END_ID, encoded, vocabulary_path, words_of
from sluice.session import stored

CAPACITY = 4096
LAST = 64
# Rows of a round in one range and one file; they are a few numbers each.
ROWS_PER_FILE = 250_000

_PIECE = pa.schema([("uid", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PIECE_DDL = "uid long, row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_SWEPT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("slot", pa.int32()), ("size", pa.int64()),
                    ("room", pa.int64()), ("rank", pa.int64()), ("lead", pa.int64())])


def _cutter(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        send = Sender(_PIECE)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(words, batch.column("text"), end_id), strict=True):
                row = uid
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    if send.add((uid, row, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None),
                                len(part) if with_ids else 0):
                        yield send.take()
                    uid += 1
        yield send.take()

    return cut


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Written pieces of every row of ``docs`` (doc_id, text); ``uid`` numbers them, ``row`` is the uid of a document's first."""
    cut = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
           .mapInArrow(_cutter(vocabulary or vocabulary_path(), capacity, end_id, with_ids), _PIECE_DDL))
    return kept(cut if with_ids else cut.drop("ids"), "pieces")


def classes(capacity: int) -> list[tuple[int, int]]:
    """(above, up to) of the size classes, from the largest down."""
    edges = [capacity, capacity // 2, capacity // 3, capacity // 4]
    while edges[-1] > 64:
        edges.append(edges[-1] // 2)
    edges = sorted({e for e in edges if e > 0}, reverse=True)
    return list(zip([*edges[1:], 0], edges, strict=True))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of slots (kind 0) and pieces (1) within this task's range, and the running maximum of (pieces - slots) before each slot."""
    part = TaskContext.get().partitionId()
    slots, pieces_, lead = 0, 0, -(1 << 62)
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if not len(kind):
            continue
        slot = kind == 0
        rank_slot = slots + np.cumsum(slot) - slot
        rank_piece = pieces_ + np.cumsum(~slot) - ~slot
        ahead = np.maximum(lead, np.maximum.accumulate(np.where(slot, rank_piece - rank_slot, -(1 << 62))))
        slots, pieces_, lead = int(slots + slot.sum()), int(pieces_ + (~slot).sum()), int(ahead[-1])
        yield pa.record_batch([pa.array(np.full(len(kind), part, np.int32)), batch.column("kind"), batch.column("id"), batch.column("slot"),
                               batch.column("size"), batch.column("room"), pa.array(np.where(slot, rank_slot, rank_piece)), pa.array(ahead)], schema=_SWEPT)


def _files(n: int) -> int:
    return max(1, -(-n // ROWS_PER_FILE))


def _round(todo: DataFrame, gaps: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """Matched (uid, size, id: the gap, slot, room: of the gap), one piece per slot; ``n``: pieces and gaps at most."""
    spark = todo.sparkSession
    slots = F.greatest(F.lit(1), F.expr(f"room div {high}")).cast("int")
    offered = (gaps.filter(F.col("room") > low).select("seq", "room", slots.alias("slots"))
               .select(F.lit(0).alias("kind"), F.col("seq").alias("id"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"),
                       F.expr("room div slots").alias("size"), "room"))
    both = offered.unionByName(todo.select(F.lit(1).alias("kind"), F.col("uid").alias("id"), F.lit(0).alias("slot"), F.col("length").alias("size"),
                                           F.lit(None).cast("bigint").alias("room")))
    order = [F.col("size").desc(), F.col("kind"), F.col("id"), F.col("slot")]
    swept = stored(both.repartitionByRange(_files(n), *order).sortWithinPartitions(*order).select("kind", "id", "slot", "size", "room").mapInArrow(
        _sweep, "part int, kind int, id long, slot int, size long, room long, rank long, lead long"))
    # A row per task that had rows.
    ends = swept.groupBy("part").agg(F.sum((F.col("kind") == 0).cast("bigint")).alias("s"), F.sum("kind").cast("bigint").alias("p"),
                                     F.max("lead").alias("lead")).orderBy("part").collect()
    before, s, p, lead = [], 0, 0, -(1 << 62)
    for end in ends:
        before.append((end["part"], s, p, lead))
        lead = max(lead, p - s + end["lead"])
        s, p = s + end["s"], p + end["p"]
    carry = F.broadcast(spark.createDataFrame(before, "part int, s long, p long, l long"))
    placed = swept.join(carry, "part")
    ahead = F.greatest("l", F.col("p") - F.col("s") + F.col("lead"))
    wanted = placed.filter("kind = 0").select("id", "slot", "room", (F.col("rank") + F.col("s") + ahead).alias("at")).filter(F.col("at") < p)
    there = placed.filter("kind = 1").select((F.col("rank") + F.col("p")).alias("at"), F.col("id").alias("uid"), "size")
    return wanted.join(there, "at").select("uid", "size", "id", "slot", "room")


def assign(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """uid, sequence_id, offset for rows (uid, length) with lengths from 1 to ``capacity``.  A sequence is named after its first piece."""
    total = sizes.count()  # gaps are no more
    out = [sizes.filter(F.col("length") * 2 > capacity).select("uid", F.col("uid").alias("seq"), F.lit(0).cast("bigint").alias("offset"))]
    gaps = stored(sizes.filter((F.col("length") * 2 > capacity) & (F.col("length") < capacity))
                  .select(F.col("uid").alias("seq"), (F.lit(capacity) - F.col("length")).alias("room")).coalesce(_files(total)))
    for low, high in classes(capacity)[1:]:
        todo = stored(sizes.filter((F.col("length") > low) & (F.col("length") <= high)).select("uid", "length").coalesce(_files(total)))
        left = todo.count()
        while left:
            own = Window.partitionBy("id").orderBy("slot")
            # At most ``capacity`` pieces share a sequence.
            filled = F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))
            placed = stored(_round(todo, gaps, low, high, total + left).select(
                "uid", F.col("id").alias("seq"), (F.lit(capacity) - F.col("room") + filled - F.col("size")).alias("offset"), "size").coalesce(_files(left)))
            fitted = placed.count()
            if not fitted:
                break
            out.append(placed.select("uid", "seq", "offset"))
            taken = placed.groupBy(F.col("seq").alias("of")).agg(F.sum("size").alias("taken"))
            gaps = stored(gaps.join(taken, F.col("seq") == F.col("of"), "left").select(
                "seq", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")).filter("room > 0").coalesce(_files(total)))
            left -= fitted
            todo = stored(todo.join(placed.select("uid"), "uid", "left_anti").coalesce(_files(left)))
            if fitted * LAST < left:
                break
        if left:
            opened = stored(_open(todo, capacity, _files(left)))
            out.append(opened.select("uid", "seq", "offset"))
            rests = opened.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).alias("room")).filter("room > 0")
            gaps = stored(gaps.unionByName(rests).coalesce(_files(total)))
    placed = out[0]
    for more in out[1:]:
        placed = placed.unionByName(more)
    return placed.select("uid", F.col("seq").alias("sequence_id"), "offset")


_OPENED = pa.schema([("uid", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64())])


def _opener(capacity: int):
    """Rows in sorted order: a new sequence begins where the next piece does not fit."""
    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(_OPENED)
        seq, used = None, capacity
        for uid, length in rows(batches):
            if used + length > capacity:
                seq, used = uid, 0
            if send.add((uid, length, seq, used)):
                yield send.take()
            used += length
        yield send.take()

    return open_


def _open(todo: DataFrame, capacity: int, files: int) -> DataFrame:
    """Neighbours by size share a new sequence, as many as fit."""
    return (todo.repartitionByRange(files, "length", "uid").sortWithinPartitions("length", "uid").select("uid", "length")
            .mapInArrow(_opener(capacity), "uid long, length long, seq long, offset long"))


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its place there; ``with_ids`` adds the ids."""
    cut = pieces(docs, capacity, vocabulary, end_id, with_ids)
    return cut.join(assign(cut.select("uid", "length"), capacity), "uid").drop("uid")


def sequences(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """sequence_id, ids (little-endian unsigned 32-bit) of every packed sequence."""
    parts = packed(docs, capacity, with_ids=True, **how)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    return parts.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, CAST('' AS BINARY), (a, p) -> concat(a, p.ids))").alias("ids"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
