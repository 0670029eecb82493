"""A dataflow given as a plain dict: source, ordered stages, sinks.

Building one composes DataFrame functions, so Spark plans source and stages together.  The
same stages serve a table and a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.operators import changes, expand, predicates, routing, shaping, validate
from sluice.plans import stages
from sluice.sinks import writers
from sluice.sources import registry

Stage = Callable[..., DataFrame]
_stages: dict[str, Stage] = {}


def register_stage(name: str, stage: Stage) -> None:
    """Add a stage type: ``stage(df, **config)`` returns a DataFrame."""
    _stages[name] = stage


def register_row_stage(name: str, rows: Callable, schema: str) -> None:
    """Add a stage written in Python over Arrow batches: ``rows(iterator of frames)``."""
    register_stage(name, lambda df, **_: df.mapInPandas(rows, schema))


def apply_stage(df: DataFrame, stage: dict) -> DataFrame:
    kind = stage["type"]
    if kind not in _stages:
        raise ValueError(f"unknown stage type {kind!r}")
    return _stages[kind](df, **stage.get("config", {}))


def apply_stages(df: DataFrame, listed: list[dict]) -> DataFrame:
    for stage in listed:
        df = apply_stage(df, stage)
    return df


def build(spark: SparkSession, spec: dict, source: DataFrame | None = None) -> DataFrame:
    """The records a dataflow sends to its sinks."""
    df = source if source is not None else registry.load(spark, spec["source"])
    return apply_stages(df, spec.get("stages", []))


def run_batch(spark: SparkSession, spec: dict, sinks: list[tuple] = (), source: DataFrame | None = None) -> int:
    """Process all current data and send it to every ``(condition, sink)``, or to the sinks of the spec."""
    return writers.fan_out(build(spark, spec, source), sinks or spec_sinks(spec))


def spec_sinks(spec: dict) -> list[tuple]:
    """``(condition, sink)`` of every ``{"type": ..., "config": ..., "condition": ...}`` under ``sinks``."""
    return [(s.get("condition"), stages.sink(s)) for s in spec.get("sinks", [])]


def run_stream(stream: DataFrame, spec: dict, sinks: list[tuple] | None, checkpoint: str, available_now: bool = True,
               interval: str = "10 seconds"):
    """The same stages on a stream; ``available_now`` processes what is there and ends."""
    out = build(stream.sparkSession, spec, stream)
    writer = writers.fan_out_stream(out, sinks or spec_sinks(spec), checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def connect(frames: dict[str, DataFrame], nodes: dict[str, dict]) -> dict[str, DataFrame]:
    """Named nodes with ``inputs``: every node reads the rows of all its inputs."""
    done = dict(frames)
    waiting = dict(nodes)
    while waiting:
        ready = [n for n, cfg in waiting.items() if all(i in done for i in cfg["inputs"])]
        if not ready:
            raise ValueError(f"inputs missing or circular for {sorted(waiting)}")
        for name in ready:
            cfg = waiting.pop(name)
            rows = expand.union_sources([done[i] for i in cfg["inputs"]])
            done[name] = apply_stage(rows, cfg) if "type" in cfg else rows
    return done


def _save(df: DataFrame, sink=None, type: str | None = None, config: dict | None = None) -> DataFrame:  # noqa: A002
    """Save the rows at this point and go on: a function, or a sink by its type."""
    return writers.tap(df, sink if sink is not None else stages.sink({"type": type, "config": config or {}}))


register_stage("filter", lambda df, condition=None, variant=None: predicates.where(df, condition, variant))
register_stage("step", lambda df, transform=None, filter=None, sample=0, select=None, exclude=None:
               shaping.step(df, transform, filter, sample, select, exclude))
register_stage("transform", lambda df, lines: shaping.transform(df, lines))
register_stage("select", shaping.select)
register_stage("drop", shaping.exclude)
register_stage("exclude", shaping.exclude)
register_stage("remap", shaping.remap)
register_stage("rename", shaping.rename)
register_stage("enrich", shaping.enrich)
register_stage("merge", lambda df, source_fields, target_field, delimiter=" ", template=None:
               shaping.merge(df, source_fields, target_field, delimiter, template))
register_stage("split", lambda df, source_field, pattern, target_fields, keep_original=True:
               shaping.split(df, source_field, pattern, target_fields, keep_original))
register_stage("default", shaping.default)
register_stage("derive", shaping.derive)
register_stage("sample", lambda df, rate, seed=0: routing.sample(df, rate, seed))
register_stage("upsert", changes.convert_upserts)
register_stage("validate", validate.validate)
register_stage("passthrough", shaping.passthrough)
register_stage("sink", _save)
for _name, _stage in stages.STAGES.items():
    register_stage(_name, _stage)


def error_column(df: DataFrame, required: list[str]) -> DataFrame:
    """Mark records that lack a required field with ``_error`` and let them go on."""
    missing = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in required]
    return df.withColumn("_error", F.coalesce(*missing))
