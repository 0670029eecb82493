"""Grouped and windowed aggregation.  The same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Aggregate functions by the name a specification uses.
FUNCTIONS = {
    "count": lambda c: F.count(F.lit(1) if c is None else c),
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


def build_aggregates(aggregates: dict[str, tuple[str, str | None]]) -> list[Column]:
    """``{output: (function, source field)}`` as aliased aggregate Columns."""
    out = []
    for name, (function, source) in aggregates.items():
        if function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {function!r}")
        out.append(FUNCTIONS[function](F.col(source) if source else None).alias(name))
    return out


def aggregate(df: DataFrame, group_by: list[str], aggregates: dict) -> DataFrame:
    """Aggregate per key; over the whole table when there is no key."""
    return df.groupBy(*group_by).agg(*build_aggregates(aggregates))


def window_aggregate(df: DataFrame, ts: str, aggregates: dict, group_by: list[str] = (),
                     size: str = "60 seconds", slide: str | None = None,
                     watermark: str | None = None) -> DataFrame:
    """Tumbling, or with ``slide`` sliding, time windows per key: ``window_start``, ``window_end``.

    ``watermark`` is the allowed delay on a stream.
    """
    if watermark:
        df = df.withWatermark(ts, watermark)
    frame = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = df.groupBy(frame.alias("_window"), *group_by).agg(*build_aggregates(aggregates))
    return grouped.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
        *group_by, *aggregates,
    )


def bucket_statistics(df: DataFrame, ts: str, field: str, group_by: list[str] = (), size: str = "60 seconds") -> DataFrame:
    """count, sum, min, max and avg of a field per window and key."""
    return window_aggregate(df, ts, {
        "count": ("count", field), "sum": ("sum", field), "min": ("min", field),
        "max": ("max", field), "avg": ("avg", field),
    }, group_by, size)


def distinct_first_seen(df: DataFrame, field: str, order: str) -> DataFrame:
    """Distinct values of ``field`` with the position they are first seen at, in that order."""
    return df.groupBy(field).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def status_counts(df: DataFrame, field: str, statuses: list[str]) -> DataFrame:
    """One row: total and the count of each status."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(F.col(field) == s).alias(s) for s in statuses])


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
                 name: str = "child_count") -> DataFrame:
    """Number of children of each parent, zero included; children are counted before the join."""
    counts = children.groupBy(child_key).agg(F.count(F.lit(1)).alias(name))
    joined = parents.join(counts, F.col(parent_key) == F.col(child_key), "left")
    return joined.select(*parents.columns, F.coalesce(name, F.lit(0)).alias(name))
