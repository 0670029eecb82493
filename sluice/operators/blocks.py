"""Order-dependent work on keys of any size.

A window ``partitionBy(key)`` puts all rows of a key in one task.  When a key is too large for
that, the rows are range-partitioned by (key, order) into blocks, so that a large key spans
many blocks.  Each block is worked on alone, a one-row summary per (key, block) is scanned to
find what a block must carry over from the blocks before it, and the carry is joined back.
Blocks hold a contiguous range of keys, so at most ``blocks - 1`` (key, block) pairs follow
another block of the same key: that bounds the carry table that is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.session import rows_per_block, shuffle_partitions, stored

BLOCK = "_block"


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows, rows of the largest key); reads only the key columns, counts before shuffling."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    return int(row["rows"] or 0), int(row["largest"] or 0)


def ordered_blocks(df: DataFrame, keys: list[str], order: list[Column], rows: int) -> DataFrame:
    """``df`` with ``_block``, numbered in (keys, order) order and stored.

    It is stored because block numbers must be the same in every later use.
    """
    count = max(shuffle_partitions(df.sparkSession), -(-rows // rows_per_block(df.sparkSession)))
    ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *order)
    return stored(ranged.withColumn(BLOCK, F.spark_partition_id()))


def same_group(left: str, right: str, names: list[str]) -> Column:
    """Join condition that treats two NULL keys as the same key."""
    return reduce(lambda a, b: a & b,
                  [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def with_carry(blocked: DataFrame, keys: list[str], summary: Column, combine, carry: str) -> DataFrame:
    """Add to each row what the earlier blocks of its key leave behind.

    ``summary`` aggregates one (key, block); ``combine`` aggregates the summaries of earlier
    blocks.  Rows of a key's first block get NULL.
    """
    names = [*keys, BLOCK]
    per_block = blocked.groupBy(*names).agg(summary.alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.withColumn(carry, combine(F.col("_part")).over(earlier)).filter(F.col(carry).isNotNull())
    bounded = F.broadcast(carried.select(*names, carry).alias("c"))
    return (
        blocked.alias("b")
        .join(bounded, same_group("b", "c", names), "left")
        .select("b.*", f"c.{carry}")
    )


# Row numbers that Spark gives inside a partition take so many bits; the number of the partition stands above them.
_INSIDE = 33


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Exact 1-based position of each row of the table, with one exchange.

    Rows are range-partitioned and sorted; their places inside a partition need no window, and one row per partition says how many rows
    stand before it.  The sorted rows are stored, since their partitions must not change afterwards.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", _INSIDE), F.col("_at").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # A row per partition: bounded by the number of partitions, hence the broadcast and the window without a key.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return placed.join(starts, part == F.col("_part")).withColumn(name, F.col("_before") + inside + 1).select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, split: bool | None = None) -> DataFrame:
    """Exact 1-based position of each row within its key (within the table without keys)."""
    if not keys and split is not False:
        return positions(df, order, name)
    rows, largest = key_sizes(df, keys)
    if split is False or (split is None and largest <= rows_per_block(df.sparkSession)):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    blocked = ordered_blocks(df, keys, order, rows)
    local = F.row_number().over(Window.partitionBy(BLOCK, *keys).orderBy(*order))
    placed = with_carry(blocked, keys, F.count(F.lit(1)), F.sum, "_before")
    return (
        placed.withColumn(name, (local + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop(BLOCK, "_before")
    )


def previous_value(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
                   split: bool | None = None) -> DataFrame:
    """Last non-NULL ``value`` among the earlier rows of the same key."""
    rows, largest = key_sizes(df, keys)
    valued = df.withColumn("_value", value)
    if split is False or (split is None and largest <= rows_per_block(df.sparkSession)):
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return valued.withColumn(name, F.last("_value", ignorenulls=True).over(before)).drop("_value")
    blocked = ordered_blocks(valued, keys, order, rows)
    before = (Window.partitionBy(BLOCK, *keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    position = F.struct(*[o for o in order])
    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), position))
    placed = with_carry(blocked, keys, latest, lambda c: F.last(c, ignorenulls=True), "_before")
    local = F.last("_value", ignorenulls=True).over(before)
    return placed.withColumn(name, F.coalesce(local, "_before")).drop(BLOCK, "_before", "_value")


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
                  split: bool | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    rows, largest = key_sizes(df, keys)
    valued = df.withColumn("_value", value)
    if split is False or (split is None and largest <= rows_per_block(df.sparkSession)):
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return valued.withColumn(name, F.sum("_value").over(upto)).drop("_value")
    blocked = ordered_blocks(valued, keys, order, rows)
    upto = Window.partitionBy(BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = with_carry(blocked, keys, F.sum("_value"), F.sum, "_before")
    return (
        placed.withColumn(name, F.sum("_value").over(upto) + F.coalesce("_before", F.lit(0)))
        .drop(BLOCK, "_before", "_value")
    )


# A rank filter up to this bound is applied before the shuffle, see
# spark.sql.optimizer.windowGroupLimitThreshold.
RANK_LIMIT = 1000


def first_rows(df: DataFrame, keys: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """The first ``count`` rows of every key.

    Small counts are cut on the map side by Spark's window group limit, so a hot key sends
    ``count`` rows per task.  Larger ones use exact numbering over blocks.
    """
    if count < RANK_LIMIT:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")
    return numbered(df, keys, order, "_rank").filter(F.col("_rank") <= count).drop("_rank")
