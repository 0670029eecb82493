"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources in code-point order (NULL last) get the weights 5, 2, 1, 5, ... of the total size; a target stops at
``MOST`` times its source and the rest is shared again by weight, which is filling to a common level.

Schedule: each source's documents are put in a random but repeatable order and cut into blocks of ``BLOCK`` words, the last
one shorter.  A source needs a number of slots to reach its target; all slots lie side by side on a line, in which
a source's stretch is its cumulative weight.  Van der Corput points (bit reversal) visit the line, so that any run of the schedule
holds the sources in nearly their target shares.  The rank of a slot among its source's slots follows from bit
arithmetic alone, and rank r stands for block r mod blocks of that source, turned a little further in each pass.  The last
slot of a source is cut so that its words reach the target.

``size``: words of the text (NULL text: 0).  Sources of size 0 have target 0.  Rows that repeat a doc_id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.base import query, table
from sluice.llm.running import running_before
from sluice.session import stored

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 4096
GOLDEN = 0.6180339887498949
# Slots that one row stands for before they are spelled out.
CHUNK = 4096


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size)."""
    spark = sized.sparkSession
    totals = stored(sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")))
    whole = int(totals.agg(F.sum("source_size")).first()[0] or 0)
    placed = running_before(totals, F.lit(""), [F.col("source").asc_nulls_last()], F.lit(1), "place")
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    level = F.lit(float(MOST)) * F.col("source_size") / F.col("weight")
    order = [level.asc(), F.col("place")]
    shared = running_before(weighed, F.lit(""), order, F.col("weight"), "weight_before")
    shared = running_before(shared, F.lit(""), order, F.col("source_size"), "size_before")
    weight = int(weighed.agg(F.sum("weight")).first()[0] or 0)
    reach = (F.lit(float(whole)) - F.lit(float(MOST)) * F.col("size_before")) / (F.lit(float(weight)) - F.col("weight_before"))
    found = shared.filter(reach <= level).agg(F.min_by(reach, F.struct("weight_before", "size_before"))).first()[0] if weight else None
    lift = F.lit(float(found if found is not None else 0.0))
    return shared.select("source", "source_size",
                         F.least(F.lit(float(MOST)) * F.col("source_size"), lift * F.col("weight")).alias("target"))


def needs(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds quota (words), blocks, turns (whole passes), rest, slots and first (place of the first slot on the line)."""
    quota = F.least(F.round("target").cast("bigint"), F.lit(MOST) * F.col("source_size"))
    df = (goal.withColumn("quota", quota).filter("quota > 0 AND source_size > 0")
          .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
          .withColumn("turns", F.expr("quota div source_size")).withColumn("rest", F.expr("quota % source_size"))
          .withColumn("turned", _turn(F.col("turns"), F.col("blocks"))))
    straight = F.col("source_size") - F.col("turned") * block
    last = F.when(F.col("rest") <= straight, F.ceil(F.col("rest") / block)).otherwise(
        F.col("blocks") - F.col("turned") + F.ceil((F.col("rest") - straight) / block))
    df = df.withColumn("slots", (F.col("turns") * F.col("blocks") + last).cast("bigint"))
    return running_before(df, F.lit(""), [F.col("source").asc_nulls_last()], F.col("slots"), "first")


def _turn(turn, blocks):
    """How far pass ``turn`` starts into the blocks."""
    return F.least(F.floor((turn * F.lit(GOLDEN) - F.floor(turn * F.lit(GOLDEN))) * blocks).cast("bigint"), blocks - 1)


def reversed_bits(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(bits):
        out = (out << 1) | ((x >> i) & 1)
    return out


def visited_before(end: np.ndarray, when: np.ndarray, bits: int) -> np.ndarray:
    """How many places below ``end`` have a reversed value below ``when``.

    Places below ``end`` fall into one run per set bit of ``end``: upper bits as in ``end`` with that bit
    cleared, lower bits free.  Reversed, the free bits lead, so that a run is an arithmetic progression.
    """
    count = np.zeros_like(when)
    for t in range(bits + 1):
        there = ((end >> t) & 1) == 1
        upper = (end >> (t + 1)) << (t + 1)
        offset = reversed_bits(upper, bits)
        step = 1 << (bits - t)
        below = np.where(when > offset, np.minimum((when - offset - 1) // step + 1, 1 << t), 0)
        count += np.where(there, below, 0)
    return count


def _schedule(bits: int, block: int):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            first, slots = f["first"].to_numpy(), f["slots"].to_numpy()
            cell = f["cell"].to_numpy()
            when = reversed_bits(cell, bits)
            rank = visited_before(first + slots, when, bits) - visited_before(first, when, bits)
            blocks, size = f["blocks"].to_numpy(), f["source_size"].to_numpy()
            turn = rank // blocks
            shift = np.minimum(np.floor((turn * GOLDEN - np.floor(turn * GOLDEN)) * blocks).astype("int64"), blocks - 1)
            number = (rank % blocks + shift) % blocks
            words = np.minimum(block, size - number * block)
            out = pd.DataFrame({"slot": when, "source": f["source"], "rank": rank, "turn": turn, "block": number, "words": words})
            final = rank == slots - 1
            if final.any():
                # Words of the last pass before its final block: whole blocks from the shift on, once round the end.
                steps = rank % blocks
                wraps = shift + steps > blocks - 1
                passed = np.where(wraps, size - shift * block + (shift + steps - blocks) * block, steps * block)
                left = f["quota"].to_numpy() - turn * size - passed
                out.loc[final, "words"] = np.minimum(left, words)[final]
            yield out

    return place


def schedule(need: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot (order in the mix), source, rank, turn, block, words.  Slots are numbered with gaps."""
    total = int(need.agg(F.sum("slots")).first()[0] or 0)
    bits = max(1, (max(total, 1) - 1).bit_length())
    chunks = need.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {CHUNK}"))))
    cells = (chunks.repartition("source", "chunk")
             .withColumn("cell", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("slots")) - 1)))
             .withColumn("cell", F.col("first") + F.col("cell")))
    return cells.select("source", "first", "slots", "cell", "blocks", "source_size", "quota").mapInPandas(
        _schedule(bits, block), "slot long, source string, rank long, turn long, block long, words long")


def mixed(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and text_hash for each row of ``docs`` (doc_id, text, source)."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
                        F.xxhash64("text").alias("text_hash"))
    keyed = F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), F.col("source")))
    order = [F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")), F.col("doc_id"), F.col("text_hash")]
    placed = stored(running_before(sized, keyed, order, F.col("size"), "start").withColumn("row", F.monotonically_increasing_id()))
    goal = stored(targets(placed))
    need = stored(needs(goal, block))
    slots = schedule(need, block)
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    use = (slots.alias("s").join(need.select("source", "source_size").alias("n"), F.col("s.source").eqNullSafe(F.col("n.source")))
           .select("s.source", "block", "words", whole.alias("whole"))
           .groupBy("source", "block")
           .agg(F.sum((F.col("words") == F.col("whole")).cast("bigint")).alias("full"),
                F.max(F.when(F.col("words") < F.col("whole"), F.col("words"))).alias("part")))
    pieces = placed.filter("size > 0").select(
        "row", "source", "start", (F.col("start") + F.col("size")).alias("end"),
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    left, right = F.greatest("start", F.col("p.block") * block), F.least("end", (F.col("p.block") + 1) * block)
    cut = F.greatest(F.lit(0), F.least(right, F.col("p.block") * block + F.coalesce("part", F.lit(0))) - left)
    taken = (pieces.alias("p").join(use.alias("u"), F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("p.block") == F.col("u.block")))
             .groupBy("row").agg(F.sum((right - left) * F.col("full") + cut).alias("taken")))
    goals = goal.withColumnRenamed("source", "_source")
    return (placed.join(taken, "row", "left").join(goals, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "text_hash"))


def repeat_to_targets(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them: a document taken t times its size stands round(t) times, one taken less than half goes.

    Identical rows share their repeats evenly.  Documents without words have no part in a mix and go.
    """
    shares = (mixed(docs, seed).groupBy("doc_id", "source", "text_hash")
              .agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("_times")).select(
                  F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"),
                  F.round("_times").cast("int").alias("_times")).filter("_times > 0"))
    joined = docs.withColumn("_own", F.xxhash64("text")).join(
        shares, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_hash")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
