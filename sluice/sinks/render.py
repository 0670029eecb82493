"""Records as the text or message rows a sink sends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.scalars import dated_name, record_json, template


def body_columns(df: DataFrame) -> list[str]:
    """Record fields, without the ``_meta`` side band."""
    return [c for c in df.columns if c != "_meta"]


def console_lines(df: DataFrame) -> DataFrame:
    """One JSON object per record, in ``value``."""
    return df.select(record_json(df).alias("value"))


def log_lines(df: DataFrame, style: str = "simple") -> DataFrame:
    """Log line per record: ``json`` (data and metadata), ``pretty`` or ``simple``."""
    names = body_columns(df)
    data = F.struct(*[F.col(f"`{n}`") for n in names])
    meta = F.col("_meta") if "_meta" in df.columns else F.lit(None).cast("struct<source:string,origin:string>")
    if style == "json":
        line = F.to_json(F.struct(data.alias("data"), meta.alias("metadata")))
    elif style == "pretty":
        line = F.concat(F.lit("Record from "), F.coalesce(meta["origin"], F.lit("")), F.lit(":\n"),
                        F.to_json(data, {"pretty": "true"}))
    elif style == "simple":
        present = sum((F.col(f"`{n}`").isNotNull().cast("int") for n in names), F.lit(0))
        line = F.concat(F.lit("Record: source="), F.coalesce(meta["source"], F.lit("")),
                        F.lit(", origin="), F.coalesce(meta["origin"], F.lit("")),
                        F.lit(", fields="), present.cast("string"))
    else:
        raise ValueError(f"unknown style {style!r}")
    return df.select(line.alias("value"))


def message_rows(df: DataFrame, topic: str, partition_key: str | None = None) -> DataFrame:
    """``key``, ``value``, ``topic`` for a message sink; the key is a template."""
    key = template(partition_key) if partition_key else F.lit(None).cast("string")
    return df.select(key.alias("key"), record_json(df).alias("value"), F.lit(topic).alias("topic"))


# Compression names a message sink accepts.
COMPRESSIONS = ("none", "gzip", "snappy", "lz4", "zstd")


def kafka_sink_options(brokers: list[str], compression: str = "none") -> dict[str, str]:
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compression!r}")
    return {"kafka.bootstrap.servers": ",".join(brokers), "kafka.compression.type": compression}


def index_name(index: str, ts: Column | None) -> Column:
    """Index name; a date pattern such as ``logs-%Y-%m-%d`` is filled from ``ts``."""
    if "%" not in index or ts is None:
        return F.lit(index)
    prefix, layout = index.split("%", 1)
    return dated_name(prefix, ts, "%" + layout)


def bulk_lines(df: DataFrame, index: str, ts: str | None = None) -> DataFrame:
    """Action line and document line of a search-index bulk body, per record."""
    action = F.to_json(F.struct(F.struct(index_name(index, F.col(ts) if ts else None).alias("_index")).alias("index")))
    return df.select(F.concat_ws("\n", action, record_json(df)).alias("value"))
