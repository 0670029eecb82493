"""SNK: written, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.catalog.base import Tables, query, register
from sluice.operators import predicates as P, validate as V
from sluice.session import scratch_path
from sluice.sinks import render, writers as W

COLUMNS = ["event_id", "event_type", "value"]
DDL = "event_id bigint, event_type string, value double"


def _events(t: Tables) -> DataFrame:
    return t.events.select(COLUMNS)


def _with_meta(t: Tables) -> DataFrame:
    meta = F.struct(F.lit("file").alias("source"), F.lit("events").alias("origin"))
    return t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"), meta.alias("_meta"))


@query("snk_01_console", """
    SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def _(t: Tables):
    path = scratch_path(t.spark, "console")
    W.write_console(t.events.select("event_id", "event_type"), path)
    return t.spark.read.text(path)


register("snk_02_log_simple", lambda t: render.log_lines(_with_meta(t), "simple"),
         "SELECT 'Record: source=file, origin=events, fields=' || CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS value FROM events")
register("snk_02_log_json", lambda t: render.log_lines(_with_meta(t), "json"),
         """SELECT '{"data":{"event_id":' || event_id || CASE WHEN event_type = 'error' THEN '' ELSE ',"kind":"' || event_type || '"' END
            || '},"metadata":{"source":"file","origin":"events"}}' AS value FROM events""")
register("snk_02_log_pretty", lambda t: render.log_lines(_with_meta(t), "pretty"))


@query("snk_03_json_by_day", "SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "daily")
    W.write_json(t.events.drop("props"), path, date_from="ts", max_records=5000)
    rows = t.spark.read.schema(DDL + ", _date string").json(path)
    return rows.withColumnRenamed("_date", "day")


@query("snk_04_archive", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS _partition_date, strftime(ts, '%H') AS _partition_hour FROM events""")
def _(t: Tables):
    path = scratch_path(t.spark, "archive")
    W.archive(t.events.select("event_id", "ts"), path, "ts", max_records=10_000)
    return t.spark.read.schema("event_id bigint, _partition_date string, _partition_hour string").json(path)


register("snk_05_message_rows", lambda t: render.message_rows(t.events.select("event_id", "user_id"), "out", "{{ .user_id }}"),
         """SELECT CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS value, 'out' AS topic FROM events""")


@query("snk_06_bulk_body", """
    SELECT '{"index":{"_index":"logs-' || strftime(o_orderdate, '%Y.%m') || '"}}' AS value FROM orders
    UNION ALL SELECT '{"o_orderkey":' || o_orderkey || ',"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '"}' FROM orders""")
def _(t: Tables):
    path = scratch_path(t.spark, "bulk")
    W.write_bulk(t.orders.select("o_orderkey", F.col("o_orderdate").alias("at")), path, "logs-%Y.%m", "at")
    return t.spark.read.text(path)


@query("snk_08_connector_by_name", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "orc")
    W.write_format(_events(t), "orc", path=path, compression="zlib")
    return t.spark.read.orc(path)


@query("snk_09_conditional", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' OR value > 20")
def _(t: Tables):
    path = scratch_path(t.spark, "some")
    W.write_where(_events(t), ".event_type == 'error' || .value > 20", lambda df: df.write.parquet(path))
    return t.spark.read.parquet(path)


@query("snk_10_fan_out", """
    SELECT 'all' AS sink, event_id FROM events UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error'""")
def _(t: Tables):
    base = scratch_path(t.spark, "fan")
    W.fan_out(_events(t), [(None, lambda df: df.write.parquet(f"{base}/sink=all")),
                           (P.condition("event_type", "eq", "error"), lambda df: df.write.parquet(f"{base}/sink=errors"))])
    return t.spark.read.parquet(base).select("sink", "event_id")


@query("snk_11_tap", """
    SELECT 'raw' AS stage, event_id FROM events UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'rest', event_id FROM events WHERE event_type = 'error' AND value > 5""")
def _(t: Tables):
    from sluice.plans import dataflow

    base = scratch_path(t.spark, "tap")
    save = lambda name: {"type": "sink", "config": {"sink": lambda df: df.write.parquet(f"{base}/stage={name}")}}
    stages = [save("raw"), {"type": "filter", "config": {"condition": ".event_type == 'error'"}}, save("errors"),
              {"type": "filter", "config": {"condition": ".value > 5"}}]
    dataflow.build(t.spark, {"stages": stages}, _events(t)).write.parquet(f"{base}/stage=rest")
    return t.spark.read.parquet(base).select("stage", "event_id")


@query("snk_12_validated", """
    SELECT 'valid' AS part, count(*) FILTER (WHERE value <= 20) AS n FROM events
    UNION ALL SELECT 'rejected', count(*) FILTER (WHERE value > 20) FROM events
    UNION ALL SELECT 'valid counter', count(*) FILTER (WHERE value <= 20) FROM events
    UNION ALL SELECT 'invalid counter', count(*) FILTER (WHERE value > 20) FROM events""")
def _(t: Tables):
    good, bad = scratch_path(t.spark, "good"), scratch_path(t.spark, "bad")
    rules = {"fields": [{"name": "value", "type": "number", "max": 20}]}
    counts = W.write_validated(_events(t), rules, lambda df: df.write.parquet(good), lambda df: df.write.parquet(bad))
    out = t.spark.read.parquet(good).agg(F.lit("valid").alias("part"), F.count(F.lit(1)).alias("n"))
    out = out.unionByName(t.spark.read.parquet(bad).agg(F.lit("rejected").alias("part"), F.count(F.lit(1)).alias("n")))
    seen = [("valid counter", counts["valid"]), ("invalid counter", counts["invalid"])]
    return out.unionByName(t.spark.createDataFrame(seen, "part string, n bigint"))


@query("snk_13_batching", "SELECT true AS within_limit, count(*) AS n FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "batches")
    limit = 3000
    W.write_format(_events(t), "parquet", path=path, **W.batching_options(max_events=limit)["options"])
    per_file = t.spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg((F.max("n") <= limit).alias("within_limit"), F.sum("n").alias("n"))


@query("snk_14_ensure_table", "SELECT CAST(event_id AS VARCHAR) AS id, props AS data, event_type AS source, 'p1' AS pipeline_id FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "target")
    table = "sluice_target_" + path.rsplit("-", 1)[1][:12]
    target = W.ensure_table(t.spark, table, location=path)
    W.ensure_table(t.spark, table, location=path)
    rows = t.events.select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("data"),
                           F.current_timestamp().alias("created_at"), F.col("event_type").alias("source"), F.lit("p1").alias("pipeline_id"))
    rows.select(*target.columns).write.insertInto(table)
    return t.spark.table(table).drop("created_at")


@query("snk_15_full_refresh", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "refresh")
    W.refresh(_events(t), path)
    W.refresh(_events(t), path)
    return t.spark.read.parquet(path)


@query("val_12_error_lines", """
    SELECT event_id, 'value: must be at most 20' AS errors FROM events WHERE value > 20""")
def _(t: Tables):
    rules = {"fields": [{"name": "value", "type": "number", "max": 20}]}
    return V.quarantine(V.check(_events(t), rules)).select("event_id", V.error_text().alias("errors"))
