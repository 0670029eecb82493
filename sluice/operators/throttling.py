"""Rate limits whose verdict on a row depends on the rows admitted before it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sluice.operators.blocks import previous_value, running_total

# Length of a rate interval in microseconds.
INTERVALS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}


def _admit_fixed(held: list[int], now: int, span: int, rate: int, capacity: int):
    """State: number of the window and rows admitted in it."""
    window = now // span
    used = held[1] if held and held[0] == window else 0
    return used < capacity, [window, used + (used < capacity)]


def _admit_sliding(held: list[int], now: int, span: int, rate: int, capacity: int):
    """State: times of the rows admitted in the last interval."""
    held = [t for t in held if t > now - span]
    ok = len(held) < capacity
    return ok, held + [now] if ok else held


def _admit_token(held: list[int], now: int, span: int, rate: int, capacity: int):
    """State: tokens, in parts of 1/span each, and the time they were counted."""
    full = capacity * span
    tokens = min(full, held[0] + (now - held[1]) * rate) if held else full
    ok = tokens >= span
    return ok, [tokens - span if ok else tokens, now]


STRATEGIES = {"fixed_window": _admit_fixed, "sliding_window": _admit_sliding, "token_bucket": _admit_token}


def admitted(df: DataFrame, keys: list[str], ts: str, tie: str, rate: int, interval: str, burst: int,
             strategy: str, held: DataFrame | None = None) -> DataFrame:
    """Admitted rows as ``keys, _tie``, and one row per key with its final state in ``_held``.

    Spark sorts (key, time, tie) within each partition and the limiter walks over it in one pass
    with the state of one key in hand, so a key of any size needs no memory.  Only these narrow
    columns move.  ``held`` is the state to start from; without it a key is cut into runs (``with_runs``) that are
    walked apart, so that a hot key is shared by many tasks.  Rows without a time are left out.
    """
    admit, span, capacity = STRATEGIES[strategy], INTERVALS[interval], rate + burst
    state_type = T.ArrayType(T.LongType())
    moments = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.when(F.lit(True), F.col(tie)).alias("_tie"),
                        F.lit(None).cast(state_type).alias("_held")).filter(F.col("_us").isNotNull())
    if held is not None:
        moments = moments.unionByName(held.select(*keys, "_held"), allowMissingColumns=True).withColumn("_run", F.lit(0).cast("bigint"))
    else:
        moments = with_runs(moments, keys, span, rate, capacity, strategy)
    parts = [*keys, "_run"]
    ordered = moments.repartition(*parts).sortWithinPartitions(*parts, F.asc_nulls_first("_us"), "_tie")
    out_schema = T.StructType([*[moments.schema[k] for k in keys], T.StructField("_tie", moments.schema["_tie"].dataType, True), T.StructField("_held", state_type)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, schema = None, [], None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field(n) for n in out_schema.names])
            got, rows = batch.to_pydict(), []
            for key, now, tie_value, start in zip(zip(*[got[k] for k in parts]), got["_us"], got["_tie"], got["_held"]):
                if key != current:
                    if current is not None:
                        rows.append((*current[:-1], None, state))
                    current, state = key, []
                if start is not None:
                    state = list(start)
                    continue
                ok, state = admit(state, now, span, rate, capacity)
                if ok:
                    rows.append((*key[:-1], tie_value, None))
            yield emit(rows)
        if current is not None:
            yield emit([(*current[:-1], None, state)])

    return ordered.mapInArrow(walk, out_schema)


def with_runs(moments: DataFrame, keys: list[str], span: int, rate: int, capacity: int, strategy: str) -> DataFrame:
    """Adds ``_run``: rows of a key in different runs do not influence each other.

    A fixed window is a run.  Otherwise a run ends at a gap after which the limiter is as new: the interval of a sliding window, or the
    time in which an empty bucket fills up.  Finding the gaps splits hot keys over blocks like all numbering does; a key without any such
    gap is one run.
    """
    if strategy == "fixed_window":
        return moments.withColumn("_run", F.floor(F.col("_us") / span))
    if strategy == "token_bucket" and rate <= 0:
        return moments.withColumn("_run", F.lit(0).cast("bigint"))  # never refilled
    rest = span if strategy == "sliding_window" else -(-capacity * span // rate)
    order = [F.col("_us"), F.col("_tie")]
    seen = previous_value(moments, keys, order, F.col("_us"), "_earlier")
    begins = F.coalesce((F.col("_us") - F.col("_earlier") >= rest).cast("int"), F.lit(1))
    return running_total(seen.withColumn("_begins", begins), keys, order, F.col("_begins"), "_run").withColumn(
        "_run", F.col("_run").cast("bigint")).drop("_earlier", "_begins")


def only_admitted(df: DataFrame, rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Rows of ``df`` that are among the admitted (keys, _tie)."""
    named = rows.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_tie")
    match = F.col(tie).eqNullSafe(F.col("_tie"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.join(named, match, "left_semi")


def throttle(df: DataFrame, keys: list[str], ts: str, tie: str, rate: int, interval: str = "second", burst: int = 0,
             strategy: str = "token_bucket") -> DataFrame:
    """At most ``rate + burst`` rows per key and interval; ``tie`` is unique within a key.

    Rows without a time cannot be judged and pass.
    """
    rows = admitted(df, keys, ts, tie, rate, interval, burst, strategy).filter(F.col("_held").isNull())
    passed = only_admitted(df, rows, keys, tie)
    return passed.unionByName(df.filter(F.col(ts).isNull())) if df.schema[ts].nullable else passed
