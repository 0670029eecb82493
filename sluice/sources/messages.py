"""Message sources: Kafka-shaped rows, read options, and unwrapping of message bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sluice.functions.scalars import json_object


def kafka_options(brokers: list[str], topics: list[str], group: str | None = None, start: str = "latest",
                  max_offsets: int | None = None, min_bytes: int | None = None, max_bytes: int | None = None,
                  max_wait: str | None = None) -> dict[str, str]:
    """Options of a Kafka read; several topics make one record stream."""
    if start not in ("earliest", "latest"):
        raise ValueError(f"unknown start position {start!r}")
    out = {"kafka.bootstrap.servers": ",".join(brokers), "subscribe": ",".join(topics), "startingOffsets": start}
    given = {"groupIdPrefix": group, "maxOffsetsPerTrigger": max_offsets, "minOffsetsPerTrigger": None,
             "kafka.fetch.min.bytes": min_bytes, "kafka.fetch.max.bytes": max_bytes, "maxTriggerDelay": max_wait}
    return out | {k: str(v) for k, v in given.items() if v is not None}


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    """Kafka topics as a stream of Kafka-shaped rows with headers."""
    return (spark.readStream.format("kafka").options(**kafka_options(**options))
            .option("includeHeaders", True).load())


def lag(progress: dict) -> int:
    """Messages a streaming query is behind, summed over topics and partitions."""
    import json

    total = 0
    for source in progress.get("sources", []):
        end, latest = (source.get(k) or {} for k in ("endOffset", "latestOffset"))
        end, latest = (json.loads(o) if isinstance(o, str) else o for o in (end, latest))
        for topic, parts in latest.items():
            total += sum(max(n - end.get(topic, {}).get(p, 0), 0) for p, n in parts.items())
    return total


def kafka_rows(key: Column, value: Column, topic: Column, partition: Column, offset: Column, ts: Column,
               headers: Column | None = None) -> list[Column]:
    """Columns of the Kafka row shape, for feeds that were landed as tables."""
    empty = F.array().cast("array<struct<key:string,value:binary>>")
    return [key.cast("binary").alias("key"), value.cast("binary").alias("value"), topic.alias("topic"),
            partition.cast("int").alias("partition"), offset.cast("bigint").alias("offset"),
            ts.cast("timestamp").alias("timestamp"), (headers if headers is not None else empty).alias("headers")]


def decode_kafka(rows: DataFrame) -> DataFrame:
    """Kafka rows as records: ``rec`` VARIANT (the JSON object, or key and value when the body is
    not one), ``_headers`` map, ``_key`` and ``_meta``.

    ``_headers`` is NULL without headers and ``_key`` is NULL when the key is empty.
    """
    key, body = F.col("key").cast("string"), F.col("value").cast("string")
    wrapped = F.to_variant_object(F.struct(key.alias("key"), body.alias("value")))
    pairs = F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string")))
    # Of a repeated key the last header counts.
    last = F.filter(pairs, lambda p, i: p["key"].isNotNull() & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    last_wins = F.map_from_entries(last)
    return rows.select(
        F.coalesce(json_object(body), wrapped).alias("rec"),
        F.when(F.size("headers") > 0, last_wins).alias("_headers"),
        F.when(F.length(key) > 0, key).alias("_key"),
        F.struct(
            F.lit("kafka").alias("source"), F.col("topic").alias("origin"),
            F.concat_ws(":", F.col("partition"), F.col("offset")).alias("offset"),
            F.unix_millis("timestamp").alias("timestamp"),
        ).alias("_meta"),
    )


def record_fields(df: DataFrame, schema: str | T.StructType, variant: str = "rec") -> DataFrame:
    """Named fields of a VARIANT record as columns in place of it."""
    fields = [F.try_variant_get(variant, f"$['{f.name}']", f.dataType.simpleString()).alias(f.name)
              for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]
    return df.select(*fields, *[c for c in df.columns if c != variant])


def unwrap_message(df: DataFrame, body: str, ts: str, metadata: list[str] = ()) -> DataFrame:
    """Message body as ``rec`` (its JSON object, else message and timestamp); metadata columns
    are copied as ``_meta_<name>``."""
    plain = F.to_variant_object(F.struct(F.col(body).alias("message"), F.col(ts).alias("timestamp")))
    return df.select(F.coalesce(json_object(F.col(body)), plain).alias("rec"),
                     *[F.col(m).alias(f"_meta_{m}") for m in metadata])


def rate_limit_options(rate: int, interval: str = "second", burst: int = 0, source: str = "kafka") -> dict[str, str]:
    """Reader option and trigger that hold a stream to ``rate + burst`` per interval."""
    seconds = {"second": 1, "minute": 60, "hour": 3600}[interval]
    option = {"kafka": "maxOffsetsPerTrigger", "file": "maxFilesPerTrigger", "rate": "rowsPerSecond"}[source]
    if source == "rate":
        return {option: str(max(1, rate // seconds))}
    return {option: str(rate + burst), "processingTime": f"{seconds} seconds"}
