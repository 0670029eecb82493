"""Running totals over sorted rows, for keys of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.session import stored


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last three columns: key, value, and NULLs to be replaced by (part, total before this row)."""
    part = TaskContext.get().partitionId()
    key, total = None, 0
    for batch in batches:
        keys, values = batch.column("_key").to_pylist(), batch.column("_value").to_pylist()
        before = []
        for k, v in zip(keys, values, strict=True):
            if k != key:
                key, total = k, 0
            before.append(total)
            total += v
        names = batch.schema.names
        columns = [batch.column(n) for n in names[:-2]]
        yield pa.record_batch([*columns, pa.array([part] * len(before), pa.int64()), pa.array(before, pa.int64())], names=names)


def running_before(df: DataFrame, key: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` (whole numbers) over the rows of the same key that come before, in ``order``.

    Rows are range-partitioned by key and order, so a large key spans many tasks.  Each task adds
    up its own rows in one pass; what a key's earlier tasks hold is added from a table with one row per
    task and key.  The result is stored, since those rows must not move afterwards.  NULL keys are one key.
    """
    keyed = df.withColumn("_key", key.cast("string")).withColumn("_value", value.cast("bigint"))
    ranged = keyed.repartitionByRange(F.col("_key"), *order).sortWithinPartitions(F.col("_key"), *order)
    columns = [*df.columns, "_key", "_value"]
    ranged = ranged.select(*columns).withColumn("_part", F.lit(0).cast("bigint")).withColumn("_before", F.lit(0).cast("bigint"))
    placed = stored(ranged.mapInArrow(_summed, ranged.schema))
    ends = placed.groupBy("_part", "_key").agg(F.max(F.col("_before") + F.col("_value")).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("_part").alias("_p"), F.col("_key").alias("_k"),
                        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    joined = placed.join(carry, (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")))
    return joined.withColumn(name, F.col("_before") + F.col("_carry")).select(*df.columns, name)
