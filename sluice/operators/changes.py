"""De-duplication, upsert conversion and applying a change log."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions.values import TypedRecord, text_of
from sluice.operators.blocks import (
    BLOCK, first_rows, key_sizes, ordered_blocks, previous_value, same_group,
)
from sluice.session import rows_per_block

CREATE, UPDATE, DELETE = "CREATE", "UPDATE", "DELETE"


# -- de-duplication ----------------------------------------------------------------------

def dedupe(df: DataFrame, keys: list[str], order: list[str], strategy: str = "keep_last",
           timestamp_field: str | None = None) -> DataFrame:
    """One row per key: first or last by ``order``, or the latest by ``timestamp_field``.

    ``order`` must be unique within a key.  Each task sends at most one row per key.
    """
    if strategy == "keep_latest":
        order = [timestamp_field, *[o for o in order if o != timestamp_field]]
    ascending = strategy == "keep_first"
    return first_rows(df, keys, [F.asc(o) if ascending else F.desc(o) for o in order])


def dedupe_within(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: float,
                  split: bool | None = None) -> DataFrame:
    """Drop a row when its key was accepted less than ``seconds`` before it.

    The waiting time restarts at each accepted row, so acceptance is sequential per key.  Only
    distinct (key, ts) pairs take part; a key larger than a block is cut into time blocks whose
    effect on a carried-in timestamp is computed independently and then chained.  Rows without
    a time cannot be judged and pass.
    """
    untimed = df.filter(F.col(ts).isNull())
    df = df.filter(F.col(ts).isNotNull())
    firsts = first_rows(df, [*keys, ts], [F.asc(tie)])
    instants = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).distinct()
    if split is None:
        split = key_sizes(df, keys)[1] > rows_per_block(df.sparkSession)
    accepted = _accepted_instants(instants, keys, int(seconds * 1_000_000), split)
    marked = firsts.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    match = same_group("l", "a", [*keys, "_t"])
    return marked.alias("l").join(accepted.alias("a"), match, "left_semi").drop("_t").unionByName(untimed)


def _accepted_instants(instants: DataFrame, keys: list[str], wait: int, split: bool) -> DataFrame:
    """(key, _t) pairs that are accepted."""
    if not split:
        return _walk_accepted(instants.withColumn("_last", F.lit(None).cast("bigint")), keys, keys, wait)
    blocked = ordered_blocks(instants, keys, [F.col("_t")], instants.count())
    names = [*keys, BLOCK]
    # Only keys that span blocks need a carry; there are fewer of them than blocks.
    spread = (blocked.groupBy(*keys).agg(F.min(BLOCK).alias("_from"), F.max(BLOCK).alias("_to"))
              .filter("_from < _to").select(*keys))
    wide = blocked.alias("b").join(F.broadcast(spread.alias("s")), same_group("b", "s", keys), "left_semi")
    carry = _block_carries(wide, keys, wait)
    placed = (blocked.alias("b").join(F.broadcast(carry.alias("c")), same_group("b", "c", names), "left")
              .select("b.*", "c._last"))
    return _walk_accepted(placed, keys, names, wait)


def _walk_accepted(rows: DataFrame, keys: list[str], group: list[str], wait: int) -> DataFrame:
    """Accept in time order within each group, starting from its ``_last`` accepted time.  One pass
    over sorted rows; nothing but the current group's last accepted time is held."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            got, kept = batch.to_pydict(), []
            for i, (name, at, start) in enumerate(zip(zip(*[got[g] for g in group]), got["_t"], got["_last"])):
                if name != current:
                    current, last = name, start
                if last is None or at - last >= wait:
                    kept.append(i)
                    last = at
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = rows.repartition(*group).sortWithinPartitions(*group, "_t")
    return ordered.mapInArrow(walk, rows.schema).select(*keys, "_t")


def _block_carries(blocked: DataFrame, keys: list[str], wait: int) -> DataFrame:
    """Last accepted time before each block of each key, as ``keys, _block, _last``."""
    key_fields = [blocked.schema[k] for k in keys]
    block_field = T.StructField(BLOCK, T.IntegerType())
    steps_schema = T.StructType([*key_fields, block_field, T.StructField("upto", T.LongType()),
                                 T.StructField("leaves", T.LongType())])

    def block_steps(pdf: pd.DataFrame) -> pd.DataFrame:
        """How the block maps the last accepted time before it to the last one inside it.

        ``upto``/``leaves``: a walk that starts at an instant up to ``upto`` (and after the
        previous ``upto``) ends at ``leaves``.
        """
        times = np.sort(pdf["_t"].to_numpy())
        hop = np.append(np.searchsorted(times, times + wait), len(times))
        end = np.arange(len(times) + 1)
        while True:
            nxt = hop[end]
            moved = nxt < len(times)
            if not moved.any():
                break
            end = np.where(moved, end[np.where(moved, nxt, 0)], end)
        starts = np.arange(min(int(np.searchsorted(times, times[0] + wait)) + 1, len(times)))
        leaves = times[end[starts]]
        edge = np.append(leaves[1:] != leaves[:-1], True)
        out = pd.DataFrame({"upto": times[starts][edge], "leaves": leaves[edge]})
        for name in [*keys, BLOCK]:
            out[name] = pdf[name].iloc[0]
        return out

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Walk over the step functions of one key's blocks."""
        out, last = [], None
        for block, part in pdf.sort_values([BLOCK, "upto"]).groupby(BLOCK, sort=True):
            out.append((block, last))
            if last is None:
                last = int(part["leaves"].iloc[0])
            else:
                hit = int(np.searchsorted(part["upto"].to_numpy(), last + wait))
                last = int(part["leaves"].iloc[hit]) if hit < len(part) else last
        got = pd.DataFrame(out, columns=[BLOCK, "_last"]).astype({"_last": "Int64"})
        for name in keys:
            got[name] = pdf[name].iloc[0]
        return got

    steps = blocked.groupBy(*keys, BLOCK).applyInPandas(block_steps, steps_schema)
    carry_schema = T.StructType([*key_fields, block_field, T.StructField("_last", T.LongType())])
    return steps.groupBy(*keys).applyInPandas(chain, carry_schema).filter(F.col("_last").isNotNull())


# -- upserts -----------------------------------------------------------------------------

def convert_upserts(df: DataFrame, entity: list[str], order: list[str], type_field: str = "event_type",
                    existing: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """Rewrite an UPDATE for an entity that does not exist at that moment to CREATE.

    CREATE and UPDATE bring an entity into being, DELETE ends it, other types leave it as it
    is.  ``existing`` lists entities that exist before the first event.  Rows that lack a part of their entity (NULL or
    empty) are left alone.
    """
    whole = has_entity(df, entity)
    return _convert_named(df.filter(whole), entity, order, type_field, existing, split).unionByName(df.filter(~whole))


def has_entity(df: DataFrame, entity: list[str]) -> Column:
    """True where every part of the entity is there."""
    parts = [F.col(e).isNotNull() & (F.col(e).cast("string") != "") for e in entity]
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts])


def _convert_named(df: DataFrame, entity: list[str], order: list[str], type_field: str, existing: DataFrame | None,
                   split: bool | None) -> DataFrame:
    kind = F.col(type_field)
    state = F.when(kind.isin(CREATE, UPDATE, DELETE), kind)
    seen = previous_value(df, entity, [F.col(o) for o in order], state, "_previous", split)
    if existing is not None:
        known = existing.select(*entity).distinct().withColumn("_known", F.lit(UPDATE)).alias("k")
        seen = (seen.alias("s").join(known, same_group("s", "k", entity), "left")
                .select("s.*", "k._known")
                .withColumn("_previous", F.coalesce("_previous", "_known")).drop("_known"))
    absent = F.col("_previous").isNull() | (F.col("_previous") == DELETE)
    return (
        seen.withColumn(type_field, F.when((kind == UPDATE) & absent, F.lit(CREATE)).otherwise(kind))
        .drop("_previous")
    )


def existing_entities(df: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose entity exists."""
    return df.join(entities.select(*keys).distinct(), keys, "left_semi")


def missing_entities(df: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose entity does not exist."""
    return df.join(entities.select(*keys).distinct(), keys, "left_anti")


def unseen_events(df: DataFrame, processed: DataFrame, id_field: str) -> DataFrame:
    """Rows whose event id was not processed before; rows without an id always pass."""
    ids = processed.select(F.col(id_field).alias("_seen")).filter(F.col("_seen").isNotNull()).distinct()
    same = F.col(id_field) == F.col("_seen")
    if isinstance(df.schema[id_field].dataType, T.StringType):
        same = same & (F.col(id_field) != "")
    return df.join(ids, same, "left_anti")


# -- delete policies ---------------------------------------------------------------------

@dataclass(frozen=True)
class DeletePolicy:
    """How deletes are detected and what they do to the table."""

    mode: str = "physical"               # physical, soft, ignore
    field_type: str | None = None        # timestamp, boolean, status, custom
    field_name: str | None = None
    delete_value: str | None = None
    active_value: str | None = None
    method: str = "null_body"            # null_body, flag_field, event_type
    detect_field: str | None = None
    detect_value: str | None = None


# The named delete policies.
PRESETS = {
    "physical": DeletePolicy("physical"),
    "soft_timestamp": DeletePolicy("soft", "timestamp", "deleted_at"),
    "soft_boolean": DeletePolicy("soft", "boolean", "is_deleted", "true", "false"),
    "soft_status": DeletePolicy("soft", "status", "status", "D", "A"),
    "cdc_soft_timestamp": DeletePolicy("soft", "timestamp", "deleted_at", method="event_type",
                                       detect_field="__op", detect_value="d"),
    "ignore": DeletePolicy("ignore"),
}


def is_delete(df: DataFrame, policy: DeletePolicy, keys: list[str], ignored: list[str] = ()) -> Column:
    """True for a delete event, never NULL.  ``ignored`` names envelope columns that are not part
    of the record's body."""
    if policy.method == "null_body":
        body = [c for c in df.columns if c not in keys and c not in ignored]
        return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in body], F.lit(True))
    if policy.method not in ("flag_field", "event_type"):
        raise ValueError(f"unknown detection method {policy.method!r}")
    f = TypedRecord(df.schema).field(policy.detect_field)
    return F.coalesce(f.text == F.lit(policy.detect_value), F.lit(False))


def mark_deletes(df: DataFrame, policy: DeletePolicy, keys: list[str], ts: str | None = None,
                 ignored: list[str] = (), now: Column | None = None) -> DataFrame:
    """Apply the policy to single events: drop deletes, or set the soft-delete field."""
    gone = is_delete(df, policy, keys, ignored)
    if policy.mode in ("physical", "ignore"):
        return df.filter(~gone)
    return df.withColumn(policy.field_name, _soft_value(df, policy, gone, ts, now))


def _soft_value(df: DataFrame, policy: DeletePolicy, gone: Column, ts: str | None, now: Column | None) -> Column:
    moment = F.col(ts) if ts else (now if now is not None else F.current_timestamp())
    if policy.field_type == "timestamp":
        return F.when(gone, moment)
    if policy.field_type == "boolean":
        return gone
    active = F.lit(policy.active_value)
    if policy.field_type == "status":
        return F.when(gone, F.lit(policy.delete_value or "D")).otherwise(F.lit(policy.active_value or "A"))
    if policy.field_type == "custom":
        if policy.delete_value == "$now":
            return F.when(gone, moment)
        if policy.active_value is None and policy.field_name in df.columns:
            active = text_of(F.col(policy.field_name), df.schema[policy.field_name].dataType)
        return F.when(gone, F.lit(policy.delete_value)).otherwise(active)
    raise ValueError(f"unknown soft-delete field type {policy.field_type!r}")


def apply_changes(log: DataFrame, keys: list[str], order: list[str], policy: DeletePolicy,
                  ts: str | None = None, envelope: list[str] = ()) -> DataFrame:
    """Current table from a change log: the latest event of each key, after the delete policy.

    ``ignore`` removes delete events first, so the latest other event stays.  A soft delete keeps
    the body of the last event that had one.
    """
    gone = is_delete(log, policy, keys, envelope)
    if policy.mode == "ignore":
        return dedupe(log.filter(~gone), keys, order).drop(*envelope)
    flagged = log.withColumn("_gone", gone)
    if policy.mode == "physical":
        return dedupe(flagged, keys, order).filter(~F.col("_gone")).drop("_gone", *envelope)
    body = [c for c in log.columns if c not in keys and c not in order and c not in envelope]
    # Both picks are cut on the map side; the first carries no body.
    newest, places = [F.desc(o) for o in order], [o for o in order if o not in keys]
    latest = first_rows(flagged.select(*keys, *places, "_gone"), keys, newest).alias("l")
    bodies = first_rows(flagged.filter(~F.col("_gone")).select(*keys, *places, *body), keys, newest).alias("b")
    current = latest.join(bodies, same_group("l", "b", keys), "left").select(
        *[F.col(f"l.{c}") for c in [*keys, *places]], *[F.col(f"b.{c}") for c in body], "l._gone")
    return (
        current.withColumn(policy.field_name, _soft_value(current, policy, F.col("_gone"), ts, None))
        .drop("_gone", *envelope)
    )


def changed_fields(df: DataFrame, new: str, old: str) -> Column:
    """Names and printed values of the fields that differ between two structs."""
    fields = df.schema[new].dataType.fields
    pairs = []
    for f in fields:
        before, after = F.col(f"{old}.{f.name}"), F.col(f"{new}.{f.name}")
        entry = F.struct(F.lit(f.name).alias("field"), text_of(before, f.dataType).alias("old"),
                         text_of(after, f.dataType).alias("new"))
        pairs.append(F.when(~before.eqNullSafe(after), entry))
    return F.array_compact(F.array(*pairs))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key by ``order``."""
    return first_rows(df, keys, [F.desc(o) for o in order])


def throttle_fixed(df: DataFrame, keys: list[str], ts: str, tie: str, rate: int, interval: str,
                   burst: int = 0) -> DataFrame:
    """At most ``rate + burst`` rows per key and calendar second, minute or hour.

    Rows without a time cannot be judged and pass.
    """
    slot = df.filter(F.col(ts).isNotNull()).withColumn("_slot", F.date_trunc(interval, F.col(ts)))
    kept = first_rows(slot, [*keys, "_slot"], [F.asc(ts), F.asc(tie)], rate + burst)
    return kept.drop("_slot").unionByName(df.filter(F.col(ts).isNull()))
