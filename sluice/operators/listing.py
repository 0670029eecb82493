"""Ordered lists, pages and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.operators.blocks import numbered


def history(df: DataFrame, ts: str, tie: str, count: int, start=None, end=None) -> DataFrame:
    """Newest ``count`` rows of a time range; each task keeps only its own newest rows."""
    from sluice.operators.predicates import in_time_range

    return df.filter(in_time_range(F.col(ts), start, end)).orderBy(F.desc(ts), F.desc(tie)).limit(count)


def keyset_page(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The ``size`` rows after ``last`` in key order."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def by_priority(df: DataFrame, priority: str, index: str) -> DataFrame:
    """Ascending priority, original order within one."""
    return df.orderBy(F.asc(priority), F.asc(index))


def listing(df: DataFrame, filters: dict | None = None, search: tuple[str, str] | None = None,
            order_by: str | None = None, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Equality filters, a substring search on one field, and an order."""
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    if search:
        df = df.filter(F.col(search[0]).contains(search[1]))
    if order_by:
        order: list[Column] = [F.desc(order_by) if descending else F.asc(order_by)]
        df = df.orderBy(*order, *([F.asc(tie)] if tie else []))
    return df


# Rows a top-k may skip; deeper pages number the rows instead, which no single task has to hold.
SKIPPED = 100_000


def numbered_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of one 1-based page, in order."""
    skipped = (page - 1) * size
    if skipped + size <= SKIPPED:
        return df.orderBy(*order).offset(skipped).limit(size)
    placed = numbered(df, [], order, "_n").filter(F.col("_n").between(skipped + 1, skipped + size))
    return placed.orderBy("_n").drop("_n")


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
