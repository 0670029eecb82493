"""AGG and SRT: aggregation, run statistics, ordered lists; WIN-02."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query, register
from sluice.operators import aggregates as A, changes, listing as L, predicates as P, shaping as S, statistics as R
from sluice.plans import dataflow

TIME = "yyyy-MM-dd HH:mm:ss"


def shown(df, *names: str):
    """Time columns as text."""
    return df.withColumns({n: F.date_format(n, TIME) for n in names})


def runs(t: Tables):
    """Run statistics, derived from orders: one run per order."""
    collected = F.floor("o_totalprice").cast("bigint")
    return t.orders.select(
        F.col("o_orderkey").alias("execution_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 20).alias("pipeline_id"),
        F.concat(F.lit("w"), F.col("o_custkey") % 4).alias("workflow_id"),
        collected.alias("records_collected"),
        (collected - F.col("o_custkey") % 50).alias("records_processed"),
        (F.col("o_orderkey") % 3).alias("collection_errors"),
        (F.col("o_custkey") % 50).alias("processing_errors"),
        F.create_map(F.lit("parse"), collected, F.lit("keep"), collected - F.col("o_custkey") % 50).alias("per_stage_counts"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 86400)")).alias("started_at"),
    )


RUNS = """
    WITH runs AS (
        SELECT o_orderkey AS execution_id, 'p' || (o_custkey % 20) AS pipeline_id, 'w' || (o_custkey % 4) AS workflow_id,
               CAST(floor(o_totalprice) AS BIGINT) AS records_collected,
               CAST(floor(o_totalprice) AS BIGINT) - o_custkey % 50 AS records_processed,
               o_orderkey % 3 AS collection_errors, o_custkey % 50 AS processing_errors,
               o_orderdate + to_seconds(o_orderkey % 86400) AS started_at
        FROM orders)"""
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in R.COUNTERS)
HOURLY = RUNS + f""", hourly AS (
        SELECT date_trunc('hour', started_at) AS bucket_hour, pipeline_id, workflow_id, {SUMS}, count(*) AS sample_count
        FROM runs GROUP BY ALL)"""


def hourly(t: Tables):
    return R.hourly_buckets(runs(t), keys=("pipeline_id", "workflow_id"))


@query("flagship_event_flow", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS kind, count(*) AS n,
           round(sum(value), 2) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k
    FROM events WHERE event_type IN ('purchase', 'click') AND value > 10 GROUP BY ALL""")
def _(t: Tables):
    dataflow.register_stage("read_k", lambda df: df.withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")))
    stages = [
        {"type": "filter", "config": {"condition": {"root": P.all_of(
            P.condition("event_type", "in", ["purchase", "click"]), P.condition("value", "gt", 10))}}},
        {"type": "transform", "config": {"lines": "kind = .event_type\norigin = 'events'"}},
        {"type": "read_k"},
        {"type": "aggregate", "config": {"ts": "ts", "size": "1 hour", "group_by": ["kind"], "aggregates_": {
            "n": ("count", None), "total": ("sum", "value"), "max_k": ("max", "k")}}},
    ]
    out = dataflow.build(t.spark, {"stages": stages}, t.events)
    return shown(out, "window_start").withColumn("total", F.round("total", 2)).drop("window_end")


@query("agg_01_bucket_statistics", """
    SELECT strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS count,
           round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 10) AS avg
    FROM events GROUP BY ALL""")
def _(t: Tables):
    out = A.bucket_statistics(t.events, "ts", "value", ["event_type"])
    out = out.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 10)})
    return shown(out, "window_start").drop("window_end")


@query("agg_02_tumbling", """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
           event_type, count(*) AS count, round(avg(value), 10) AS avg_value FROM events GROUP BY ALL""")
def _(t: Tables):
    out = A.window_aggregate(t.events, "ts", {"count": ("count", None), "avg_value": ("avg", "value")}, ["event_type"], "1 hour")
    return shown(out.withColumn("avg_value", F.round("avg_value", 10)), "window_start", "window_end")


@query("agg_02_sliding", """
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS count FROM (
        SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM events
        UNION ALL SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def _(t: Tables):
    out = A.window_aggregate(t.events, "ts", {"count": ("count", None)}, ["event_type"], "2 hours", "1 hour")
    return shown(out, "window_start").drop("window_end")


FOUR = {"n": ("count", None), "qty": ("sum", "l_quantity"), "least": ("min", "l_extendedprice"), "most": ("max", "l_extendedprice")}
register("agg_03_group_by", lambda t: A.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], FOUR),
         "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS least, "
         "max(l_extendedprice) AS most FROM lineitem GROUP BY ALL")
register("agg_03_global", lambda t: A.aggregate(t.lineitem, [], FOUR),
         "SELECT count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem")


def _counted(t: Tables):
    """Counters of one run over the events."""
    stages = [("keep", lambda df: P.where(df, P.condition("value", "gt", 5))),
              ("shape", lambda df: S.select(df, ["event_id", "event_type"])),
              ("click", lambda df: P.where(df, ".event_type == 'click'"))]
    out, seen = R.counted_chain(t.events, stages)
    out.write.format("noop").mode("overwrite").save()
    return seen


@query("agg_04_run_statistics", """
    SELECT count(*) AS records_collected, count(*) FILTER (WHERE value > 5 AND event_type = 'click') * 2 AS records_processed,
           count(*) FILTER (WHERE value > 5) AS keep, count(*) FILTER (WHERE value > 5 AND event_type = 'click') AS click,
           count(*) FILTER (WHERE event_type = 'error') AS collection_errors,
           1 + count(*) FILTER (WHERE value > 20 AND event_type = 'click') AS processing_errors, true AS timed
    FROM events""")
def _(t: Tables):
    """Two sinks that work and one that fails; errors and duration are those of the run."""
    rows = t.events.select("event_id", "event_type", "value")
    stages = [("keep", lambda df: df.filter("value > 5")), ("click", lambda df: df.filter("event_type = 'click'"))]
    good = lambda df: df.write.format("noop").mode("overwrite").save()
    broken = lambda df: df.select("not there")
    run = R.run_counted(rows, stages, [(None, good), (".value > 10", good), (None, broken)], F.col("event_type") == "error", F.col("value") > 20)
    row = (run["records_collected"], run["records_processed"], run["per_stage_counts"]["keep"], run["per_stage_counts"]["click"],
           run["collection_errors"], run["processing_errors"], run["duration_ms"] > 0)
    return t.spark.createDataFrame([row], "records_collected bigint, records_processed bigint, keep bigint, click bigint, collection_errors bigint, "
                                          "processing_errors bigint, timed boolean")


@query("agg_05_stage_statistics", """
    WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE value > 5) AS b,
                      count(*) FILTER (WHERE value > 5 AND event_type = 'click') AS d FROM events)
    SELECT 'keep' AS stage, a AS input, b AS output, a - b AS dropped FROM c
    UNION ALL SELECT 'shape', b, b, 0 FROM c UNION ALL SELECT 'click', b, d, b - d FROM c""")
def _(t: Tables):
    rows = [(s["stage"], s["input"], s["output"], s["dropped"]) for s in R.stage_statistics(_counted(t))]
    return t.spark.createDataFrame(rows, "stage string, input bigint, output bigint, dropped bigint")


register("agg_06_hourly_buckets", lambda t: shown(hourly(t), "bucket_hour"),
         HOURLY + " SELECT * REPLACE (strftime(bucket_hour, '%Y-%m-%d %H:%M:%S') AS bucket_hour) FROM hourly")
register("agg_07_stage_count_merge",
         lambda t: R.merge_stage_counts(runs(t), ["pipeline_id"]).select(
             "pipeline_id", F.col("per_stage_counts")["parse"].alias("parse"), F.col("per_stage_counts")["keep"].alias("keep")),
         RUNS + " SELECT pipeline_id, CAST(sum(records_collected) AS BIGINT) AS parse, CAST(sum(records_processed) AS BIGINT) AS keep "
         "FROM runs GROUP BY ALL")


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("agg_08_workflow_totals", HOURLY + " SELECT " + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS total_{c}" for c in R.COUNTERS) +
    " FROM hourly WHERE bucket_hour BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:00:00' AND workflow_id = 'w1'")
def _(t: Tables):
    return R.workflow_totals(hourly(t), _ntz("1996-01-01 00:00:00"), _ntz("1996-12-31 23:00:00"),
                             where=F.col("workflow_id") == "w1")


register("agg_08_empty_range", lambda t: R.workflow_totals(hourly(t), _ntz("1950-01-01 00:00:00"), _ntz("1950-01-02 00:00:00")),
         "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS total_{c}" for c in R.COUNTERS))
register("agg_09_per_pipeline", lambda t: R.per_pipeline(hourly(t).filter("workflow_id = 'w2'")),
         HOURLY + f" SELECT pipeline_id, {SUMS} FROM hourly WHERE workflow_id = 'w2' GROUP BY pipeline_id")
register("agg_10_execution_totals",
         lambda t: R.execution_totals(t.lineitem.select(F.col("l_orderkey").alias("execution_id"), F.col("l_quantity").cast("bigint")
                                                        .alias("record_count"), F.col("l_linenumber").cast("bigint").alias("error_count"))),
         "SELECT l_orderkey AS execution_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_records, "
         "CAST(sum(l_linenumber) AS BIGINT) AS failed_records FROM lineitem GROUP BY l_orderkey")


@query("agg_11_provider_hourly", """
    SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket_hour,
           CAST(sum(k) AS BIGINT) AS total_records, CAST(sum(k % 7) AS BIGINT) AS failed_records,
           count(DISTINCT user_id) AS total_groups, count(DISTINCT CASE WHEN value > 5 THEN user_id END) AS active_groups
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL""")
def _(t: Tables):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("bad", F.col("k") % 7)
    return shown(R.provider_hourly(rows, "event_type", "ts", "user_id", "k", "bad", F.col("value") > 5), "bucket_hour")


@query("agg_12_throughput", """
    SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS records,
           count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) / 60.0::DOUBLE AS per_second,
           count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE) AS error_rate FROM events GROUP BY 1""")
def _(t: Tables):
    return shown(R.throughput(t.events, "ts", F.col("event_type") == "error"), "slot")


LATEST = RUNS + """, latest AS (SELECT * FROM runs
        QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, execution_id DESC) = 1)"""


def latest_runs(t: Tables):
    return changes.latest_per_key(runs(t), ["pipeline_id"], ["started_at", "execution_id"])


register("win_02_latest_run",
         lambda t: shown(latest_runs(t), "started_at").select("pipeline_id", "execution_id", "records_collected", "started_at"),
         LATEST + " SELECT pipeline_id, execution_id, records_collected, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM latest")
register("agg_13_node_metrics", lambda t: R.node_metrics(latest_runs(t)),
         LATEST + """ SELECT pipeline_id, 'source' AS node, records_collected AS n FROM latest
            UNION ALL SELECT pipeline_id, 'sink', records_processed FROM latest
            UNION ALL SELECT pipeline_id, 'parse', records_collected FROM latest
            UNION ALL SELECT pipeline_id, 'keep', records_processed FROM latest""")
register("agg_16_distinct_first_seen", lambda t: A.distinct_first_seen(t.events, "event_type", "event_id"),
         "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type")
register("agg_17_status_counts", lambda t: A.status_counts(t.orders, "o_orderstatus", ["F", "O", "P"]),
         "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, "
         "count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders")
register("agg_18_child_counts",
         lambda t: A.child_counts(t.customer.select("c_custkey"), t.orders.filter("o_totalprice > 400000"), "c_custkey", "o_custkey"),
         "SELECT c_custkey, count(o_orderkey) AS child_count FROM customer LEFT JOIN orders "
         "ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey")


# -- lists and pages ---------------------------------------------------------------------

register("srt_01_history",
         lambda t: L.history(runs(t), "started_at", "execution_id", 50, _ntz("1995-01-01 00:00:00"), _ntz("1999-01-01 00:00:00"))
         .select("execution_id", "pipeline_id"),
         RUNS + " SELECT execution_id, pipeline_id FROM runs WHERE started_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-01-01' "
         "ORDER BY started_at DESC, execution_id DESC LIMIT 50")
register("srt_02_keyset_page", lambda t: L.keyset_page(t.orders, "o_orderkey", 1200, 100).select("o_orderkey", "o_custkey"),
         "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1200 ORDER BY o_orderkey LIMIT 100")
register("srt_03_priority", lambda t: L.by_priority(t.orders, "o_orderpriority", "o_orderkey").select("o_orderpriority", "o_orderkey"),
         "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey")
register("srt_04_listing",
         lambda t: L.listing(t.part, {"p_type": "ECONOMY"}, ("p_name", "ring"), "p_retailprice", True, "p_partkey")
         .select("p_partkey", "p_name", "p_retailprice"),
         "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = 'ECONOMY' AND contains(p_name, 'ring') "
         "ORDER BY p_retailprice DESC, p_partkey")
register("srt_05_limit", lambda t: t.orders.orderBy("o_orderkey").limit(25).select("o_orderkey"),
         "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
register("srt_06_numbered_page",
         lambda t: L.numbered_page(t.orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 20).select("o_orderkey"),
         "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
register("srt_06_page_counts", lambda t: L.page_counts(t.orders, 20),
         "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM orders")
