"""Database change feeds as flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Operation letters of a change feed and the event types they stand for.
OPERATIONS = {"c": "INSERT", "r": "INSERT", "u": "UPDATE", "d": "DELETE"}


def paired(feed: DataFrame) -> DataFrame:
    """Keep the row images an operation has: both for an update, one for insert and delete."""
    op = F.col("op")
    return feed.withColumns({
        "before": F.when(op.isin("u", "d"), F.col("before")),
        "after": F.when(op != "d", F.col("after")),
    })


def flatten(feed: DataFrame, keys: list[str]) -> DataFrame:
    """``op, db, tbl, ts, before, after`` as records.

    Current row fields are at the top level and NULL for a delete, ``_old_data`` is the earlier
    image, ``_primary_key`` comes from the row that exists.
    """
    fields = feed.schema["after"].dataType.names
    pair = paired(feed)
    kind: Column = F.col("op")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), kind)
    row = F.coalesce("after", "before")
    return pair.select(
        kind.alias("_cdc_type"), F.col("db").alias("_database"), F.col("tbl").alias("_table"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("_timestamp"),
        *[F.col(f"after.{f}").alias(f) for f in fields],
        F.col("before").alias("_old_data"),
        F.array(*[row[k].cast("string") for k in keys]).alias("_primary_key"),
        F.struct(F.lit("cdc").alias("source"), F.concat_ws(".", "db", "tbl").alias("origin"),
                 F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp")).alias("_meta"),
    )
