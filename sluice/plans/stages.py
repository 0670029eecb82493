"""Stages and sinks under the option names that stored dataflow specs use.

Each function takes a spec's options and calls the operator; older option names of this library stay valid.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from sluice.operators import aggregates, changes, expand, predicates, routing, shaping, throttling
from sluice.sinks import writers

ARRIVAL = "_arrival"


def _orderable(df: DataFrame) -> list[str]:
    plain = (T.AtomicType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, plain)]


def dedupe(df: DataFrame, key_fields: list[str] | None = None, strategy: str = "keep_last", window: float | None = None,
           timestamp_field: str | None = None, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``window`` (seconds) drops a key that was accepted less than that before.  Without ``order``, rows count in the order of
    ``timestamp_field`` and their other fields, or as the source delivers them."""
    keys = list(key_fields or keys)
    if order is None and timestamp_field:
        order = [timestamp_field, *[c for c in _orderable(df) if c != timestamp_field]]
    if window:
        if not timestamp_field:
            raise ValueError("a window needs timestamp_field")
        numbered = df.withColumn(ARRIVAL, F.struct(*[F.col(o) for o in order]))
        return changes.dedupe_within(numbered, keys, timestamp_field, ARRIVAL, window).drop(ARRIVAL)
    if order is None:
        return changes.dedupe(df.withColumn(ARRIVAL, F.monotonically_increasing_id()), keys, [ARRIVAL], strategy).drop(ARRIVAL)
    return changes.dedupe(df, keys, order, strategy, timestamp_field)


def cast(df: DataFrame, casts: dict[str, str], date_format: str | None = None, error_action: str | None = None,
         on_error: str = "null") -> DataFrame:
    return shaping.cast(df, casts, date_format, error_action or on_error)


def timestamp(df: DataFrame, action: str, target_field: str | None = None, source_field: str | None = None, timezone: str = "UTC",
              input_format: str | None = None, output_format: str | None = None, target: str | None = None,
              source: str | None = None) -> DataFrame:
    return shaping.timestamp(df, action, target_field or target, source_field or source, timezone, input_format, output_format)


def encrypt(df: DataFrame, fields: list[str], method: str = "sha256", key_env: str | None = None, mask_char: str = "*",
            mask_keep_first: int = 0, mask_keep_last: int = 0, keep_first: int = 0, keep_last: int = 0) -> DataFrame:
    return shaping.encrypt(df, fields, method, key_env, mask_char, mask_keep_first or keep_first, mask_keep_last or keep_last)


def throttle(df: DataFrame, rate: int, interval: str = "second", burst: int = 0, strategy: str = "fixed_window", drop_on_limit: bool = True,
             keys: list[str] = (), ts: str | None = None, tie: str | None = None) -> DataFrame:
    """Rows over the limit are dropped; with ``drop_on_limit`` false they would wait, so a table passes whole (limit a stream at its
    source instead).  ``ts`` is the time of a row, ``tie`` tells rows of one time apart."""
    if not drop_on_limit:
        return df
    if not ts or not tie:
        raise ValueError("throttling a table needs ts and tie")
    if strategy == "fixed_window":
        return changes.throttle_fixed(df, list(keys), ts, tie, rate, interval, burst)
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    return throttling.throttle(keyed, list(keys) or ["_all"], ts, tie, rate, interval, burst, strategy).select(*df.columns)


def aggregate(df: DataFrame, aggregates_: dict | None = None, group_by: list[str] = (), ts: str | None = None, size: str = "60 seconds",
              slide: str | None = None, watermark: str | None = None, **named) -> DataFrame:
    wanted = named.pop("aggregates", None) or aggregates_
    if named:
        raise TypeError(f"unknown options {sorted(named)}")
    wanted = {k: tuple(v) for k, v in wanted.items()}
    if ts:
        return aggregates.window_aggregate(df, ts, wanted, group_by, size, slide, watermark)
    return aggregates.aggregate(df, list(group_by), wanted)


def _policy(preset: str | None, mode: str, logical: dict | None, detect: dict) -> changes.DeletePolicy:
    if preset:
        return changes.PRESETS[preset]
    if mode in ("physical", "ignore"):
        return changes.DeletePolicy(mode, **detect)
    if mode != "logical" or not logical:
        raise ValueError("a delete stage is physical, or logical with field and value")
    field, value = logical["field"], str(logical["value"])
    if value == "$now":
        return changes.DeletePolicy("soft", "timestamp", field, **detect)
    if value in ("true", "True"):
        return changes.DeletePolicy("soft", "boolean", field, "true", "false", **detect)
    return changes.DeletePolicy("soft", "custom", field, value, **detect)


def delete(df: DataFrame, keys: list[str], mode: str = "physical", logical: dict | None = None, preset: str | None = None, ts: str | None = None,
           ignored: list[str] = (), order: list[str] | None = None, **detect) -> DataFrame:
    """With ``order`` the events are applied: the latest of each key, after the policy, so that a physical delete removes its row.

    Without it single events are marked, which only logical deletes can be; a physical one could but vanish and leave its row behind.
    ``detect``: method, detect_field, detect_value.
    """
    policy = _policy(preset, mode, logical, detect)
    if order:
        return changes.apply_changes(df, keys, order, policy, ts, ignored)
    if policy.mode == "physical":
        raise ValueError("a physical delete stage needs order, by which it applies the events")
    return changes.mark_deletes(df, policy, keys, ts, ignored)


def route(df: DataFrame, routes: list[dict], field: str | None = None, default: str | None = None, fan_out: bool = False) -> DataFrame:
    """By value (``match``) of ``field`` or by ``filter``; first hit, or with ``fan_out`` every hit."""
    if field:
        routes = [{"filter": {"field": field, "op": "in", "value": r["match"]}, "target": r["target"]} for r in routes]
    pairs = [(r.get("filter"), r["target"]) for r in routes]
    if not fan_out:
        return routing.route_first(df, pairs, default)
    hits = routing.route_all(df, pairs)
    if default is None:
        return hits
    met = reduce(lambda a, b: a | b, [predicates.passes(df, spec) for spec, _ in pairs], F.lit(False))
    return hits.unionByName(df.filter(~F.coalesce(met, F.lit(False))).withColumn(routing.ROUTE, F.lit(default)))


def lookup(df: DataFrame, table: DataFrame | dict | str, keys: list[str], fields: list[str] | None = None, name: str | None = None) -> DataFrame:
    """``table``: a DataFrame, a source spec, or a table name.  Of several rows of a key one counts, so no record is multiplied."""
    found = _rows(df, table)
    wanted = found.select(*dict.fromkeys([*keys, *fields])) if fields else found
    return expand.lookup(df, wanted.dropDuplicates(keys), keys, name)


def for_each(df: DataFrame, child: DataFrame | dict | str, bindings: dict[str, str], mode: str = "for_each_record") -> DataFrame:
    return expand.expand(df, _rows(df, child), bindings, mode)


def _rows(df: DataFrame, table: DataFrame | dict | str) -> DataFrame:
    from sluice.sources import registry

    if isinstance(table, DataFrame):
        return table
    return registry.load(df.sparkSession, table) if isinstance(table, dict) else df.sparkSession.table(table)


def apply_log(df: DataFrame, keys: list[str], order: list[str], preset: str = "physical", ts: str | None = None, envelope: list[str] = ()) -> DataFrame:
    return changes.apply_changes(df, keys, order, changes.PRESETS[preset], ts, envelope)


STAGES: dict[str, Callable[..., DataFrame]] = {
    "dedupe": dedupe, "cast": cast, "timestamp": timestamp, "encrypt": encrypt, "throttle": throttle, "aggregate": aggregate, "delete": delete,
    "route": route, "lookup": lookup, "expand": for_each, "json_parse": shaping.json_parse, "apply_changes": apply_log,
}


# -- sinks -------------------------------------------------------------------------------

_sinks: dict[str, Callable[..., Callable]] = {}


def register_sink(name: str, make: Callable[..., Callable]) -> None:
    """Add a sink type: ``make(**config)`` returns a function of the rows and the batch id (None for a table)."""
    _sinks[name] = make


def sink(spec: dict) -> Callable[..., None]:
    """The sink of ``{"type": ..., "config": {...}}``; unknown types are Spark format names."""
    config = dict(spec.get("config", {}))
    kind = spec["type"]
    if kind in _sinks:
        return _sinks[kind](**config)
    return lambda df, batch_id=None: writers.write_format(df, kind, **config)


def _files(path: str, format: str = "json", mode: str = "append", **options) -> Callable:  # noqa: A002
    """Files of one format.  A batch of a stream has a folder of its own, which a retry replaces."""
    def write(df: DataFrame, batch_id: int | None = None) -> None:
        if batch_id is None:
            df.write.format(format).mode(mode).options(**options).save(path)
        else:
            df.write.format(format).mode("overwrite").options(**options).save(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def _lines(write: Callable[[DataFrame, str], None]) -> Callable[..., Callable]:
    def make(path: str, **options) -> Callable:
        return lambda df, batch_id=None: write(df, path if batch_id is None else f"{path.rstrip('/')}/batch={batch_id}", **options)

    return make


for _name in ("file", "hdfs", "s3", "gcs"):
    register_sink(_name, _files)
register_sink("stdout", _lines(writers.write_console))
register_sink("elasticsearch", _lines(writers.write_bulk))
register_sink("kafka", lambda **cfg: lambda df, batch_id=None: writers.write_kafka(df, **cfg))
register_sink("sql", lambda **cfg: lambda df, batch_id=None: writers.write_table(df, **cfg))
register_sink("stub", lambda: lambda df, batch_id=None: df.write.format("noop").mode("append").save())
