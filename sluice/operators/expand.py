"""Lookups, parent-to-child expansion, hierarchies and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sluice.session import shuffle_partitions, stored


def lookup(df: DataFrame, table: DataFrame, keys: list[str], name: str | None = None,
           fields: list[str] | None = None) -> DataFrame:
    """Left join with a lookup table that has one row per key.

    Not hinted: Spark broadcasts the table when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts both sides, splitting skewed
    partitions of ``df``.  Works with a stream on the left.
    """
    wanted = table.select(*keys, *fields) if fields else table
    out = df.join(wanted, keys, "left")
    return out.withColumn("enriched_from", F.lit(name)) if name else out


# Items of an array of repeats.
REPEATS = 10_000


def expand_for_each(parent: DataFrame, child: DataFrame, bindings: dict[str, str]) -> DataFrame:
    """Child rows for every parent row, with ``{parent field: child field}`` bound by equality.

    Parent rows with the same bound values repeat the child rows.  They are counted before the
    join, so the join itself is many-to-one however often a value repeats.  Up to ``REPEATS`` repeats are spelled out where the join has put
    the row; more are cut into chunks of that size, which are dealt to all tasks before they are spelled out.
    """
    names = {p: f"_p{i}" for i, p in enumerate(bindings)}
    driving = (
        parent.groupBy(*[F.col(p).alias(n) for p, n in names.items()])
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    on = reduce(lambda a, b: a & b, [F.col(names[p]) == F.col(c) for p, c in bindings.items()])
    joined = lambda some: child.join(driving.filter(some), on).select(*child.columns, "_times")
    copies = lambda n: F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("_copy")
    few = joined(F.col("_times") <= REPEATS).select(*child.columns, copies(F.col("_times")))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_times - 1) div {REPEATS}"))).alias("_chunk")
    inside = F.least(F.lit(REPEATS).cast("bigint"), F.col("_times") - F.col("_chunk") * REPEATS)
    # Dealt to a fixed number of tasks, since chunks are few bytes and would be put together again.
    many = (joined(F.col("_times") > REPEATS).select(*child.columns, "_times", chunk)
            .repartition(shuffle_partitions(child.sparkSession), *bindings.values(), "_chunk").select(*child.columns, copies(inside)))
    return few.unionByName(many).drop("_copy")


def expand(parent: DataFrame, child: DataFrame, bindings: dict[str, str], mode: str = "for_each_record",
           stored_parent: DataFrame | None = None) -> DataFrame:
    """Child rows of an expansion.  Mode ``none`` runs the child once, unbound.  When the parent
    produced nothing, the stored table of its type drives the expansion."""
    if mode == "none":
        return child
    if stored_parent is not None and parent.isEmpty():
        parent = stored_parent
    return expand_for_each(parent, child, bindings)


def hierarchy_depth(types: DataFrame, key: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """``depth`` of each row: itself plus its ancestors, at most ``max_depth`` where that is given.

    Without it, rows that are on a circle of parents or below one have no depth: NULL.  They are what is left when a round
    reaches no root any more, since above every row that climbs on in vain there would be nearer ones that arrive.

    Every row knows an ancestor and the steps to it; a round lets it jump on by what that
    ancestor knows, so the reach doubles and the rounds grow with the logarithm of the depth.
    Rows that reached their root take no part in later joins.
    """
    there = types.select(F.col(key).alias("_k"))
    climbing = (
        types.join(there, F.col(parent) == F.col("_k"), "left_semi")
        .select(F.col(key).alias("_k"), F.col(parent).alias("_up"), F.lit(1).alias("_steps"))
    )
    reached = None
    reach = 1
    while True:
        jump = climbing.select(F.col("_k").alias("_at"), F.col("_up").alias("_far"), F.col("_steps").alias("_more"))
        known = jump if reached is None else jump.unionByName(
            reached.select(F.col("_k").alias("_at"), F.lit(None).cast(climbing.schema["_up"].dataType).alias("_far"),
                           F.col("_steps").alias("_more")))
        moved = stored(climbing.join(known, F.col("_up") == F.col("_at"), "left").select(
            "_k", F.col("_far").alias("_up"), (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("_steps")))
        done = moved.filter(F.col("_up").isNull())
        reached = done if reached is None else reached.unionByName(done)
        climbing = moved.filter(F.col("_up").isNotNull())
        reach *= 2
        if climbing.isEmpty() or (done.isEmpty() if max_depth is None else reach >= max_depth):
            break
    circling = F.lit(None).cast("int") if max_depth is None else F.col("_steps")
    steps = reached.select("_k", "_steps", F.lit(True).alias("_ends")).unionByName(climbing.select("_k", circling.alias("_steps"), F.lit(max_depth is not None).alias("_ends")))
    depth = F.when(F.coalesce("_ends", F.lit(True)), F.coalesce("_steps", F.lit(0)) + 1)
    if max_depth is not None:
        depth = F.least(depth, F.lit(max_depth))
    return types.join(steps.withColumnRenamed("_k", key), key, "left").select(*types.columns, depth.alias("depth"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of all sources; fields a source lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def undefined_columns(df: DataFrame, defined: list[str]) -> list[str]:
    """Columns that a definition does not name."""
    return sorted(set(df.columns) - set(defined))


def undefined_keys(document: Column, defined: list[str]) -> Column:
    """Keys of a JSON object that a definition does not name, sorted."""
    keys = F.map_keys(F.try_variant_get(document, "$", "map<string,variant>"))
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(d) for d in defined])))
