"""Routes, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.operators.blocks import numbered
from sluice.operators.predicates import passes

ROUTE = "_route"


def route_first(df: DataFrame, routes: list[tuple], default: str | None = None, name: str = ROUTE) -> DataFrame:
    """Tag each row with the output of the first condition it meets; unrouted rows are dropped."""
    target = F.lit(None).cast("string")
    if default is not None:
        target = F.lit(default)
    for spec, output in reversed(routes):
        target = F.when(passes(df, spec), F.lit(output)).otherwise(target)
    return df.withColumn(name, target).filter(F.col(name).isNotNull())


def route_all(df: DataFrame, routes: list[tuple], name: str = ROUTE) -> DataFrame:
    """One copy of each row per condition it meets."""
    hits = F.array(*[F.when(passes(df, spec), F.lit(output)) for spec, output in routes])
    return df.withColumn(name, F.explode(F.array_compact(hits)))


def copy_to_all(df: DataFrame, outputs: list[str], name: str = ROUTE) -> DataFrame:
    """One copy of each row per output."""
    return route_all(df, [(None, output) for output in outputs], name)


def route_by_value(df: DataFrame, field: str, routes: list[dict], default: str | None = None,
                   name: str = ROUTE) -> DataFrame:
    """Route on the value of ``field``: ``[{"match": [...], "target": name}]``."""
    tree = [({"field": field, "op": "in", "value": r["match"]}, r["target"]) for r in routes]
    return route_first(df, tree, default, name)


def route_to_models(df: DataFrame, field: str, models: dict[str, str], name: str = "_model") -> DataFrame:
    """Route on a discriminator: ``{discriminator value: model id}``."""
    return route_by_value(df, field, [{"match": [v], "target": m} for v, m in models.items()], name=name)


def branch(df: DataFrame, output: str, name: str = ROUTE) -> DataFrame:
    """Rows routed to one output."""
    return df.filter(F.col(name) == output).drop(name)


def round_robin(df: DataFrame, outputs: list[str], order: list[Column], name: str = ROUTE) -> DataFrame:
    """Deal the rows, in ``order``, to the outputs in turn.  Exact, without a single-task sort."""
    dealt = numbered(df, [], order, "_n")
    choice = F.element_at(F.array(*[F.lit(o) for o in outputs]),
                          (F.pmod(F.col("_n") - 1, F.lit(len(outputs))) + 1).cast("int"))
    return dealt.withColumn(name, choice).drop("_n")


def spread_by_key(df: DataFrame, outputs: list[str], key: Column, name: str = ROUTE) -> DataFrame:
    """Stream form of the split: an even share per output, decided by a hash of ``key``."""
    choice = F.element_at(F.array(*[F.lit(o) for o in outputs]),
                          (F.pmod(F.xxhash64(key), F.lit(len(outputs))) + 1).cast("int"))
    return df.withColumn(name, choice)


def sample(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Keep each row with probability ``rate``; works on tables and streams.  Rate 0 is off."""
    if rate <= 0 or rate >= 1:
        return df
    return df.filter(F.rand(seed) < F.lit(rate)) if df.isStreaming else df.sample(rate, seed)


# Multiplier and modulus of the repeatable sample.
HASH_MULTIPLIER = 2654435761
HASH_SPACE = 1_000_000


def sample_by_key(df: DataFrame, key: Column, rate: float) -> DataFrame:
    """Keep the same share of integer keys in every run."""
    bucket = F.pmod(key.cast("bigint") % HASH_SPACE * HASH_MULTIPLIER, F.lit(HASH_SPACE))
    return df.filter(bucket < F.lit(int(rate * HASH_SPACE)))
