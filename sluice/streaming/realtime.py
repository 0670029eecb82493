"""Stateful stream operators: upserts, the realtime chain, throttling, latest row per key.

Sequential rules need the rows of a key, in order, in one place.  The operators built on
``applyInPandasWithState`` see one micro-batch of a key at a time, which the source's batch
limit bounds, and keep a small state per key.  ``TableChain`` is the form for streams with very
hot entities: it runs the block-wise batch operators on each micro-batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.blocks import first_rows, previous_value, same_group
from sluice.operators.changes import CREATE, DELETE, UPDATE, has_entity
from sluice.functions.values import TypedRecord
from sluice.operators.predicates import to_column
from sluice.operators.throttling import INTERVALS, STRATEGIES, admitted, only_admitted
from sluice.streaming.dedup import WrittenEvents
from sluice.streaming.state import KeyedState

def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable").reset_index(drop=True)


def _exact(df: DataFrame, order: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Whole numbers as text on their way through pandas, which would turn a column with NULLs into
    floating point; and the way back.  Order columns are added as ``_o0``, ``_o1``, …"""
    whole = [f for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    packed = (df.withColumns({f"_o{i}": F.col(name) for i, name in enumerate(order)})
              .withColumns({f.name: F.col(f.name).cast("string") for f in whole}))

    def unpack(out: DataFrame) -> DataFrame:
        return out.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in whole})

    return packed, unpack


def _filter_forms(df: DataFrame, spec, type_field: str) -> tuple[Column, Column]:
    """The filter for an event as it is, and for the same event turned into a CREATE."""
    as_is = F.coalesce(to_column(spec, TypedRecord(df.schema)), F.lit(True if not spec else False))
    if not spec:
        return F.lit(True), F.lit(True)
    return as_is, F.coalesce(to_column(spec, _Created(df.schema, type_field)), F.lit(False))


class _Created(TypedRecord):
    """Record view in which the event type reads CREATE."""

    def __init__(self, schema: T.StructType, type_field: str):
        super().__init__(schema)
        self.type_field = type_field

    def field(self, path: str):
        found = super().field(path)
        if path.strip(".") != self.type_field:
            return found
        return type(found)(F.lit(CREATE), T.StringType(), F.lit(True), F.lit(False))


REALTIME_STATE = "alive boolean, ids array<string>, marked array<bigint>"


def realtime(stream: DataFrame, entity: list[str], order: list[str], type_field: str = "event_type",
             condition=None, id_field: str | None = None, ttl_seconds: int = 86_400) -> DataFrame:
    """Duplicate check, upsert rewrite and filter in the order of the realtime chain.

    State moves only for rows that are written.  Without ``condition`` and ``id_field`` this is
    the stateful upsert conversion.  Rows that lack a part of their entity are not rewritten and keep no
    entity state.  With ``id_field``, copies of an event must carry the same
    entity, and an entity's state holds its ids of the last ``ttl_seconds``; when no row comes for an entity any more, a timer
    takes the expired ones out.
    """
    as_is, as_create = _filter_forms(stream, condition, type_field)
    judged, unpack = _exact(stream.withColumns({"_as_is": as_is, "_as_create": as_create}), order)
    columns = stream.columns
    schema = judged.select(columns).schema
    sort = [f"_o{i}" for i in range(len(order))]

    def keep_state(state: GroupState, alive: bool, seen: dict[str, int], now: int) -> None:
        """An entity that does not exist and has no ids needs no state; the oldest id sets the timer."""
        if not alive and not seen:
            if state.exists:
                state.remove()
            return
        state.update((alive, list(seen.keys()), list(seen.values())))
        if seen:
            state.setTimeoutDuration(max(1, min(seen.values()) + ttl_seconds * 1000 - now))

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = int(time.time() * 1000)
        alive, ids, marked = state.get if state.exists else (False, [], [])
        seen = {i: m for i, m in zip(ids, marked) if m > now - ttl_seconds * 1000}
        if state.hasTimedOut:
            keep_state(state, alive, seen, now)
            return
        pdf = _in_order(frames, sort)
        named = all(part is not None and part == part and part != "" for part in key)
        names = pdf[id_field].tolist() if id_field else [None] * len(pdf)
        keep, kinds = [], []
        for i, (name, kind, is_ok, create_ok) in enumerate(zip(names, pdf[type_field], pdf["_as_is"], pdf["_as_create"])):
            name = None if name is None or pd.isna(name) or name == "" else str(name)
            if name in seen:
                continue
            created = named and kind == UPDATE and not alive
            if not (create_ok if created else is_ok):
                continue
            kind = CREATE if created else kind
            if named and kind in (CREATE, UPDATE, DELETE):
                alive = kind != DELETE
            if name is not None:
                seen[name] = now
            keep.append(i)
            kinds.append(kind)
        keep_state(state, alive, seen, now)
        if keep:
            out = pdf.iloc[keep][columns].copy()
            out[type_field] = kinds
            yield out

    return unpack(judged.groupBy(*entity).applyInPandasWithState(
        advance, schema, REALTIME_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout))


class TableChain:
    """The realtime chain for ``foreachBatch``, with ids and entities kept as tables.

    Every step splits hot keys.  Filter verdicts may depend on the rewritten type; an event then
    either fixes its entity's state whatever came before, or leaves it alone, so the state before
    each event is the last fixed one.  With such a filter a duplicate's fate would depend on the
    state too: use ``realtime`` when ids repeat.
    """

    def __init__(self, spark: SparkSession, path: str, entity: list[str], entity_ddl: str, order: list[str],
                 type_field: str, condition=None, ids: WrittenEvents | None = None):
        if ids is not None and condition is not None and reads_field(condition, type_field):
            raise ValueError("a filter on the event type cannot be combined with de-duplication here")
        self.spark, self.entity, self.order = spark, entity, order
        self.type_field, self.condition, self.ids = type_field, condition, ids
        self.state = KeyedState(spark, path, f"{entity_ddl}, alive boolean, batch bigint", entity,
                                lambda rows: first_rows(rows, entity, [F.desc("batch")]))

    def alive(self, batch_id: int) -> DataFrame:
        """Entities that exist before this batch."""
        return self.state.before(batch_id).filter("alive").select(*self.entity)

    def convert(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows to write, with rewritten types."""
        if self.ids is not None:
            passed = batch.filter(_filter_forms(batch, self.condition, self.type_field)[0])
            batch = self.ids.unseen(passed, batch_id, self.order)
        as_is, as_create = _filter_forms(batch, self.condition, self.type_field)
        judged = batch.withColumns({"_as_is": as_is, "_as_create": as_create})
        kind = F.col(self.type_field)
        fixes = (F.when((kind == DELETE) & F.col("_as_is"), F.lit(False))
                 .when((kind == CREATE) & F.col("_as_is"), F.lit(True))
                 .when((kind == UPDATE) & F.col("_as_create"), F.lit(True)))
        seen = previous_value(judged, self.entity, [F.col(o) for o in self.order], fixes, "_alive")
        known = self.alive(batch_id).withColumn("_known", F.lit(True)).alias("k")
        seen = (seen.alias("s").join(known, same_group("s", "k", self.entity), "left").select("s.*", "k._known"))
        alive = F.coalesce("_alive", "_known", F.lit(False))
        created = (kind == UPDATE) & ~alive & has_entity(seen, self.entity)
        return (
            seen.filter(F.when(created, F.col("_as_create")).otherwise(F.col("_as_is")))
            .withColumn(self.type_field, F.when(created, F.lit(CREATE)).otherwise(kind))
            .select(*batch.columns)
        )

    def mark(self, written: DataFrame, batch_id: int) -> None:
        """Store ids and entity states of written rows."""
        if self.ids is not None:
            self.ids.mark(written, batch_id)
        position = F.struct(*[F.col(o) for o in self.order])
        kind = F.col(self.type_field)
        states = (written.filter(kind.isin(CREATE, UPDATE, DELETE) & has_entity(written, self.entity)).groupBy(*self.entity)
                  .agg((F.max_by(kind, position) != DELETE).alias("alive")))
        self.state.put(states.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)

    def handler(self, write: Callable[[DataFrame, int], DataFrame],
                steps: Callable[[DataFrame], DataFrame] = lambda df: df):
        """``foreachBatch`` function: check, rewrite, filter, steps, write, mark."""
        def handle(batch: DataFrame, batch_id: int) -> None:
            self.mark(write(steps(self.convert(batch, batch_id)), batch_id), batch_id)

        return handle


def reads_field(spec, name: str) -> bool:
    """Does a filter read this field?"""
    from sluice.operators.predicates import parse_expression

    if isinstance(spec, str):
        spec = parse_expression(spec)
    if "root" in spec or "expression" in spec:
        return reads_field(spec.get("root") or spec["expression"], name)
    children = spec.get("and") or spec.get("or")
    if children:
        return any(reads_field(c, name) for c in children)
    return spec.get("field", "").strip(".") == name


# -- throttling --------------------------------------------------------------------------

def throttle(stream: DataFrame, keys: list[str], ts: str, tie: str, rate: int, interval: str = "second",
             burst: int = 0, strategy: str = "token_bucket") -> DataFrame:
    """Admit at most ``rate + burst`` rows per key and interval, by a fixed window, a sliding window
    or a token bucket refilled at ``rate``.  Rows over the limit are dropped; to slow down instead,
    limit the source.  Rows without a time cannot be judged and pass.  ``ThrottleTable`` is the form for keys too large for one task's memory."""
    timed, unpack = _exact(stream.filter(F.col(ts).isNotNull()), [tie])
    timed = timed.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    admit, span, columns = STRATEGIES[strategy], INTERVALS[interval], stream.columns
    schema = timed.select(columns).schema

    def limit(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _in_order(frames, ["_us", "_o0"])
        held = [int(v) for v in state.get[0]] if state.exists else []
        keep = []
        for i, now in enumerate(pdf["_us"].tolist()):
            ok, held = admit(held, now, span, rate, rate + burst)
            if ok:
                keep.append(i)
        state.update((held,))
        if keep:
            yield pdf.iloc[keep][columns]

    out = unpack(timed.groupBy(*keys).applyInPandasWithState(
        limit, schema, "held array<bigint>", "append", GroupStateTimeout.NoTimeout))
    return out.unionByName(stream.filter(F.col(ts).isNull())) if stream.schema[ts].nullable else out


class ThrottleTable:
    """Throttling for ``foreachBatch``, with the limiter's state per key kept as a table."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], ts: str, tie: str, rate: int,
                 interval: str = "second", burst: int = 0, strategy: str = "token_bucket"):
        self.spark, self.path, self.keys, self.ts, self.tie = spark, path, keys, ts, tie
        self.limits = (rate, interval, burst, strategy)
        self.state: KeyedState | None = None

    def _state(self, batch: DataFrame) -> KeyedState:
        fields = [*[batch.schema[k] for k in self.keys], T.StructField("_held", T.ArrayType(T.LongType())), T.StructField("batch", T.LongType())]
        return KeyedState(self.spark, f"{self.path}/limits", T.StructType(fields), self.keys,
                          lambda rows: first_rows(rows, self.keys, [F.desc("batch")]))

    def handler(self, write: Callable[[DataFrame, int], DataFrame]):
        """``foreachBatch`` function: limit, store the state, write the admitted rows."""
        def handle(batch: DataFrame, batch_id: int) -> None:
            self.state = self.state or self._state(batch)
            # Also where it is empty: without a state a key is walked in runs, whose ends would all be kept.
            held = self.state.before(batch_id).select(*self.keys, "_held")
            out = admitted(batch, self.keys, self.ts, self.tie, *self.limits, held=held)
            # Both results of the walk are read from here; a later batch replaces what the one before it left.
            target = f"{self.state.home}/walk-{batch_id % 2}"
            out.write.mode("overwrite").parquet(target)
            walked = self.spark.read.schema(out.schema).parquet(target)
            write(only_admitted(batch, walked.filter(F.col("_held").isNull()), self.keys, self.tie)
                  .unionByName(batch.filter(F.col(self.ts).isNull())), batch_id)
            self.state.put(walked.filter(F.col("_held").isNotNull()).withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)

        return handle


# -- latest row per key ------------------------------------------------------------------

def latest(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key as an update-mode aggregation, which is pre-aggregated in each task."""
    position = F.struct(*[F.col(o) for o in order])
    return (
        stream.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys])
        .agg(F.max_by(F.struct(*[F.col(c) for c in stream.columns]), position).alias("_row"))
        .select("_row.*")
    )


class LatestTable:
    """The newest row of every key, from the changed keys of each micro-batch; kept as a compacted table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.state = KeyedState(spark, path, T.StructType([*schema.fields, T.StructField("batch", T.LongType())]), keys,
                                lambda rows: first_rows(rows, keys, [F.desc("batch")]))

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        self.state.put(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)

    def current(self) -> DataFrame:
        return self.state.current().drop("batch")
