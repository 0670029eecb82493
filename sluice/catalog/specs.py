"""Stages and sinks given as plain specs with the documented option names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query
from sluice.plans import dataflow
from sluice.session import scratch_path


def _run(t: Tables, rows, *stages: tuple):
    return dataflow.build(t.spark, {"stages": [{"type": kind, "config": config} for kind, config in stages]}, rows)


def _events(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


@query("win_01_spec_dedupe", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def _(t: Tables):
    return _run(t, _events(t), ("dedupe", {"key_fields": ["user_id"], "strategy": "keep_latest", "timestamp_field": "ts"}),
                ("select", {"fields": ["user_id", "ts"]}))


@query("win_04_spec_dedupe_window", """
    SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def _(t: Tables):
    """A window longer than the table keeps the first of each key."""
    out = _run(t, _events(t).select("event_id", "user_id", "event_type", "ts"),
               ("dedupe", {"key_fields": ["event_type", "user_id"], "window": 10 ** 9, "timestamp_field": "ts", "order": ["event_id"], "strategy": "keep_first"}))
    return out.select("event_type", "event_id")


@query("prj_14_spec_cast", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(t: Tables):
    return _run(t, t.orders.select("o_orderkey", "o_orderstatus", "o_custkey"),
                ("cast", {"casts": {"o_orderstatus": "int", "o_custkey": "string"}, "error_action": "null"}))


@query("prj_17_spec_timestamp", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def _(t: Tables):
    return _run(t, t.orders.select("o_orderkey", "o_orderdate"), ("timestamp", {
        "action": "format", "target_field": "day", "source_field": "o_orderdate", "output_format": "02/01/2006"}), ("drop", {"fields": ["o_orderdate"]}))


@query("prj_12_spec_mask", "SELECT c_custkey, c_phone[1:2] || repeat('#', length(c_phone) - 3) || right(c_phone, 1) AS c_phone FROM (SELECT c_custkey, c_name AS c_phone FROM customer)")
def _(t: Tables):
    return _run(t, t.customer.select("c_custkey", F.col("c_name").alias("c_phone")), ("encrypt", {
        "fields": ["c_phone"], "method": "mask", "mask_char": "#", "mask_keep_first": 2, "mask_keep_last": 1}))


@query("win_05_spec_throttle", """
    SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5""")
def _(t: Tables):
    return _run(t, _events(t), ("throttle", {"rate": 3, "burst": 2, "interval": "hour", "strategy": "fixed_window", "drop_on_limit": True,
                                             "ts": "ts", "tie": "event_id"}), ("select", {"fields": ["event_id"]}))


@query("agg_03_spec_aggregate", "SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type")
def _(t: Tables):
    return _run(t, _events(t), ("aggregate", {"group_by": ["event_type"], "aggregates": {"n": ["count", None], "total": ["sum", "value"]}}))


@query("flt_24_spec_route_fan_out", """
    SELECT event_id, 'clicks' AS _route FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'large' FROM events WHERE value > 50
    UNION ALL SELECT event_id, 'rest' FROM events WHERE NOT coalesce(event_type = 'click', false) AND NOT coalesce(value > 50, false)""")
def _(t: Tables):
    from sluice.operators.routing import ROUTE

    return _run(t, _events(t).select("event_id", "event_type", "value"), ("route", {
        "fan_out": True, "default": "rest", "routes": [{"filter": ".event_type == 'click'", "target": "clicks"}, {"filter": ".value > 50", "target": "large"}]},
    )).select("event_id", F.col(ROUTE).alias("_route"))


@query("cdc_05_spec_delete", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'gone' END AS state FROM events""")
def _(t: Tables):
    return _run(t, _events(t).select("event_id", "event_type").withColumn("state", F.lit(None).cast("string")), ("delete", {
        "keys": ["event_id"], "mode": "logical", "logical": {"field": "state", "value": "gone"}, "method": "event_type", "detect_field": "event_type",
        "detect_value": "error"}), ("select", {"fields": ["event_id", "state"]}))


@query("cdc_04_spec_physical_delete", """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
    WHERE n = 1 AND event_type <> 'error'""")
def _(t: Tables):
    """The latest event of each user; users whose latest event deletes them are gone."""
    return _run(t, _events(t).select("event_id", "user_id", "event_type"), ("delete", {
        "keys": ["user_id"], "mode": "physical", "order": ["event_id"], "method": "event_type", "detect_field": "event_type", "detect_value": "error"}),
        ("select", {"fields": ["user_id", "event_id"]}))


@query("jon_01_spec_lookup", "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def _(t: Tables):
    twice = t.region.unionByName(t.region).withColumnRenamed("r_regionkey", "n_regionkey")
    return _run(t, t.nation, ("lookup", {"table": twice, "keys": ["n_regionkey"], "fields": ["r_name"]}),
                ("select", {"fields": ["n_nationkey", "r_name"]}))


@query("jon_02_spec_expand", "SELECT n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(t: Tables):
    return _run(t, t.region, ("expand", {"child": {"type": "parquet", "path": t.path("nation")}, "bindings": {"r_regionkey": "n_regionkey"}}),
                ("select", {"fields": ["n_nationkey"]}))


@query("snk_10_spec_sinks", """
    SELECT 'all' AS sink, event_id FROM events UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error'""")
def _(t: Tables):
    base = scratch_path(t.spark, "spec-sinks")
    files = lambda name: {"type": "file", "config": {"format": "parquet", "path": f"{base}/sink={name}"}}
    spec = {"source": {"type": "parquet", "path": t.path("events")}, "stages": [{"type": "select", "config": {"fields": ["event_id", "event_type"]}}],
            "sinks": [files("all"), files("errors") | {"condition": ".event_type == 'error'"}]}
    dataflow.run_batch(t.spark, spec)
    return t.spark.read.parquet(base).select("sink", "event_id")
