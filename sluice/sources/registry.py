"""Sources by type name, and sources made of several partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.operators.expand import union_sources
from sluice.sources import demo, files, messages, tables

_sources: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register_source(name: str, load: Callable[[SparkSession, dict], DataFrame]) -> None:
    """Add a source type: ``load(spark, config)`` returns its DataFrame."""
    _sources[name] = load


def register_data_source(spark: SparkSession, cls) -> None:
    """Register a Python ``DataSource`` class and make it a source type of the same name."""
    spark.dataSource.register(cls)
    register_source(cls.name(), lambda s, cfg: s.read.format(cls.name()).options(**cfg).load())


def load(spark: SparkSession, config: dict) -> DataFrame:
    """The DataFrame of ``{"type": ..., ...}``; unknown types are Spark format names."""
    kind = config["type"]
    rest = {k: v for k, v in config.items() if k != "type"}
    if kind in _sources:
        return _sources[kind](spark, rest)
    return files.read_files(spark, kind, rest.pop("path"), **rest)


def load_partitioned(spark: SparkSession, config: dict, partitions: list[dict]) -> DataFrame:
    """One read per enabled partition, its config laid over the common one, all rows together."""
    enabled = [p for p in partitions if p.get("enabled", True)]
    if not enabled:
        return load(spark, config)
    return union_sources([load(spark, config | p.get("config", {})) for p in enabled])


def _file(spark: SparkSession, cfg: dict) -> DataFrame:
    fmt, path = cfg.get("format", "json"), cfg["path"]
    if fmt == "csv":
        return files.read_csv(spark, path, cfg.get("delimiter", ","))
    if fmt == "lines":
        return files.read_lines(spark, path)
    if fmt == "parquet":
        return files.read_parquet(spark, path)
    if fmt == "json_array":
        return files.read_json_array(spark, path, cfg.get("schema"))
    return files.read_json(spark, path, cfg.get("schema"))


register_source("file", _file)
register_source("sql", lambda s, cfg: tables.read_sql(s, **cfg))
register_source("sql_event", lambda s, cfg: tables.new_events(
    load(s, cfg["table"]), cfg.get("last", 0), **{k: v for k, v in cfg.get("options", {}).items() if k not in ("batch_size", "order_by")}))
register_source("kafka", lambda s, cfg: messages.decode_kafka(messages.read_kafka(s, **cfg)))
register_source("demo", lambda s, cfg: demo.generate(s, int(cfg.get("count", 10)), cfg.get("source", "demo")))
register_source("generate", lambda s, cfg: demo.sample_logs(s.range(int(cfg.get("count", 10)))))
