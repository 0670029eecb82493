"""Writing records: files, archives, tables, connectors, and several sinks at once."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice.operators.predicates import where
from sluice.operators.shaping import partition_keys
from sluice.operators.validate import check, quarantine, valid
from sluice.session import scratch_path
from sluice.sinks.render import bulk_lines, console_lines, kafka_sink_options, message_rows

Sink = Callable[[DataFrame], None]


def write_json(df: DataFrame, path: str, mode: str = "append", date_from: str | None = None,
               max_records: int | None = None, compression: str | None = None) -> None:
    """JSON lines.  ``date_from`` puts each day in its own folder, ``max_records`` rolls files."""
    if date_from:
        df = df.withColumn("_date", F.date_format(date_from, "yyyy-MM-dd"))
    w = df.write.mode(mode)
    if date_from:
        w = w.partitionBy("_date")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    if compression:
        w = w.option("compression", compression)
    w.json(path)


def archive(df: DataFrame, path: str, ts: str, mode: str = "append", max_records: int | None = None,
            compression: str = "gzip") -> None:
    """Compressed JSON lines under a folder per date and hour.

    Rows are rebalanced by folder: quiet hours share a task, a busy hour is split over several,
    so files keep a sensible size either way.  ``max_records`` rolls them earlier.
    """
    keyed = partition_keys(df, ts)
    if not df.isStreaming:
        keyed = keyed.hint("rebalance", F.col("_partition_date"), F.col("_partition_hour"))
    w = keyed.write.mode(mode).option("compression", compression)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.partitionBy("_partition_date", "_partition_hour").json(path)


def write_text(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Rendered lines as text files."""
    lines.select("value").write.mode(mode).text(path)


def write_console(df: DataFrame, path: str) -> None:
    """JSON lines, as the console prints them."""
    write_text(console_lines(df), path)


def write_bulk(df: DataFrame, path: str, index: str, ts: str | None = None) -> None:
    write_text(bulk_lines(df, index, ts), path)


def write_kafka(df: DataFrame, brokers: list[str], topic: str, partition_key: str | None = None,
                compression: str = "none") -> None:
    (message_rows(df, topic, partition_key).write.format("kafka")
     .options(**kafka_sink_options(brokers, compression)).save())


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 1000, **options) -> None:
    """SQL table through JDBC; each task sends batches of ``batch_size`` rows."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=batch_size, **options).save()


def write_format(df: DataFrame, fmt: str, mode: str = "append", **options) -> None:
    """Any connector Spark knows, by its format name."""
    df.write.format(fmt).mode(mode).options(**options).save()


def refresh(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Full refresh: replace the target, so that a second run gives the same table."""
    df.write.format(fmt).mode("overwrite").save(path)


def write_where(df: DataFrame, condition, sink: Sink) -> None:
    """Send only the records that meet the condition."""
    sink(where(df, condition))


def fan_out(df: DataFrame, sinks: list[tuple], keep: bool = False) -> int:
    """Send every record to every ``(condition, sink)``; returns the number of sinks.

    A table is read once per sink, each with its own condition at the scan.  ``keep`` holds the
    rows while the sinks read them: for micro-batches and for costly stages with a small output.
    """
    if keep:
        df = df.persist()
    try:
        for condition, sink in sinks:
            write_where(df, condition, sink)
    finally:
        if keep:
            df.unpersist()
    return len(sinks)


def fan_out_stream(stream: DataFrame, sinks: list[tuple], checkpoint: str):
    """Every micro-batch to every sink.

    A sink that takes two arguments also gets the batch id, by which it can replace what a failed attempt has
    written; one that takes only the rows may see a retried batch twice.
    """
    def bound(sink, batch_id: int):
        return (lambda df: sink(df, batch_id)) if len(inspect.signature(sink).parameters) > 1 else sink

    def send(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch, [(condition, bound(sink, batch_id)) for condition, sink in sinks], keep=True)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def tap(df: DataFrame, sink: Sink) -> DataFrame:
    """Save the records at this point and go on with them."""
    sink(df)
    return df


VERDICT = "_verdict"


def split_validated(df: DataFrame, schema: dict, path: str) -> dict[str, int]:
    """Write every row once, below ``path`` in the folder of its verdict, valid or rejected; returns their counts.

    Rows are read and checked once, and the counts come from the write itself.  Rejected rows keep their ``_errors``.
    """
    from pyspark.sql import Observation

    seen = Observation()
    good = F.size("_errors") == 0
    counted = check(df, schema).observe(seen, F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"))
    counted.withColumn(VERDICT, F.when(good, "valid").otherwise("rejected")).write.partitionBy(VERDICT).parquet(path)
    return dict(seen.get)


def write_validated(df: DataFrame, schema: dict, sink: Sink, rejects: Sink | None = None) -> dict[str, int]:
    """Write valid records; rejected ones go to ``rejects`` or are dropped.  Returns the counts.

    The sinks read what ``split_validated`` has stored, so they check nothing again, and the counts are there whatever a sink does.
    """
    path = scratch_path(df.sparkSession, "validated")
    counts = split_validated(df, schema, path)
    fields = check(df, schema).schema
    stored_rows = df.sparkSession.read.schema(T.StructType([*fields.fields, T.StructField(VERDICT, T.StringType())])).parquet(path)
    sink(valid(stored_rows.filter(F.col(VERDICT) == "valid").drop(VERDICT)))
    if rejects is not None:
        rejects(quarantine(stored_rows.filter(F.col(VERDICT) == "rejected").drop(VERDICT)))
    return counts


def batching_options(max_events: int | None = None, timeout: str | None = None) -> dict[str, dict[str, str]]:
    """Flush limits of a buffered sink as writer options and trigger."""
    out: dict[str, dict[str, str]] = {"options": {}, "trigger": {}}
    if max_events:
        out["options"] = {"maxRecordsPerFile": str(max_events), "batchsize": str(max_events)}
    if timeout:
        out["trigger"] = {"processingTime": timeout}
    return out


# Columns of a target table when none are given.
DEFAULT_COLUMNS = [
    {"name": "id", "type": "VARCHAR(36)", "primary_key": True},
    {"name": "data", "type": "JSON", "nullable": True},
    {"name": "created_at", "type": "TIMESTAMP", "default": "CURRENT_TIMESTAMP"},
    {"name": "source", "type": "VARCHAR(255)", "nullable": True},
    {"name": "pipeline_id", "type": "VARCHAR(36)", "nullable": True},
]
COLUMN_TYPES = {"JSON": "STRING", "TEXT": "STRING", "SERIAL": "BIGINT", "INTEGER": "INT"}


def table_ddl(table: str, columns: list[dict] | None = None, location: str | None = None) -> str:
    """``CREATE TABLE IF NOT EXISTS``.  The primary key and column defaults are kept as table
    properties: parquet tables do not enforce them."""
    columns = columns or DEFAULT_COLUMNS
    parts, properties = [], {}
    for c in columns:
        kind = COLUMN_TYPES.get(c["type"].upper(), c["type"])
        parts.append(f"`{c['name']}` {kind}" + ("" if c.get("nullable") else " NOT NULL"))
        if c.get("default"):
            properties[f"default.{c['name']}"] = c["default"]
    key = [c["name"] for c in columns if c.get("primary_key")]
    if key:
        properties["primary_key"] = ",".join(key)
    ddl = f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(parts)}) USING parquet"
    if location:
        ddl += f" LOCATION '{location}'"
    if properties:
        ddl += " TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")"
    return ddl


def ensure_table(spark: SparkSession, table: str, columns: list[dict] | None = None,
                 location: str | None = None) -> DataFrame:
    """Create the target table unless it exists, and return it."""
    spark.sql(table_ddl(table, columns, location))
    return spark.table(table)
