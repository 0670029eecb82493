"""STR: the tables read as streams, processed to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.catalog.base import Tables, query, register
from sluice.catalog.changes import BY_OP, COPIES, LATEST, TYPED, UPSERTS, change_log, typed_events, with_copies
from sluice.operators.changes import DeletePolicy
from sluice.operators import aggregates as A, expand as X, predicates as P, shaping as S, statistics
from sluice.plans import dataflow
from sluice.session import scratch_path
from sluice.streaming import dedup, realtime as RT, run
from sluice.streaming.changes import ChangeTable
from sluice.streaming.windows import LateRows, WindowTable

TIME = "yyyy-MM-dd HH:mm:ss"


def _stream(t: Tables, name: str = "events") -> DataFrame:
    """A table as a stream; as a pattern, because the table may be one file rather than a folder."""
    path = t.path(name)
    return run.stream_table(t.spark, f"{path[:-1]}[{path[-1]}]", getattr(t, name).schema)


# Micro-batches of a fed stream, and files of each.
BATCHES = 4
FILES = 4


def _fed(t: Tables, rows: DataFrame, label: str, part) -> DataFrame:
    """A derived table as a stream of ``BATCHES`` micro-batches: those rows first whose ``part`` is 0, then 1, and so on.

    Each part is written by several tasks into ``FILES`` files, which one micro-batch reads.
    """
    path = scratch_path(t.spark, label)
    for i in range(BATCHES):
        some = rows.filter(F.coalesce(part, F.lit(0)) == i)
        if not some.isEmpty():
            some.repartition(FILES).write.mode("append").parquet(path)
    return run.stream_table(t.spark, path, rows.schema, max_files=FILES)


def _stored_stream(t: Tables, rows: DataFrame, label: str) -> DataFrame:
    """A derived table of events, fed in the order of time."""
    cuts = t.events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / BATCHES for i in range(1, BATCHES)], 1000)).first()[0] or []
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    return _fed(t, rows, label, sum([(moment > cut).cast("int") for cut in cuts], F.lit(0)))


def _events_in_time(t: Tables) -> DataFrame:
    return _stored_stream(t, t.events.drop("props"), "events")


FIRST_COPY = COPIES + """ SELECT event_id, event_type FROM copies WHERE value > 2
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY copy) = 1"""


@query("str_01_dedup_written_events", FIRST_COPY)
def _(t: Tables):
    """Filter first, then drop events already written; ids are kept as a table."""
    stream = _stored_stream(t, with_copies(t).drop("props"), "copies")
    ids = dedup.WrittenEvents(t.spark, scratch_path(t.spark, "ids"), "event_id")
    out = scratch_path(t.spark, "unique")
    handle = ids.handler(dedup.batch_store(t.spark, out), ["copy"], before=lambda df: df.filter("value > 2"))
    run.run_batches(stream, handle, "dedup")
    return t.spark.read.parquet(out).select("event_id", "event_type")


@query("str_01_dedup_within_watermark", FIRST_COPY)
def _(t: Tables):
    stream = run.with_event_time(_stored_stream(t, with_copies(t).drop("props"), "copies"), "ts")
    unique = dedup.dedup_within(stream.filter("value > 2"), "event_id", "ts", "24 hours")
    return run.run_to_table(unique.select("event_id", "event_type"), "unique")


@query("str_01_dedup_processing_time", FIRST_COPY)
def _(t: Tables):
    stream = _stored_stream(t, with_copies(t).drop("props"), "copies").filter("value > 2")
    return run.run_to_table(dedup.dedup_ttl(stream, "event_id"), "unique").select("event_id", "event_type")


def _typed_stream(t: Tables) -> DataFrame:
    return _stored_stream(t, typed_events(t).drop("props"), "typed")


register("str_02_stateful_upsert",
         lambda t: run.run_to_table(RT.realtime(_typed_stream(t), ["user_id"], ["ts", "event_id"]), "upserts", timers=True)
         .select("event_id", "user_id", "event_type"), UPSERTS)


def _table_chain(t: Tables, condition=None, steps=lambda df: df) -> DataFrame:
    """The chain with ids and entities kept as tables."""
    path, out = scratch_path(t.spark, "entities"), scratch_path(t.spark, "chain")
    ids = None if condition and RT.reads_field(condition, "event_type") else dedup.WrittenEvents(
        t.spark, scratch_path(t.spark, "ids"), "event_id")
    chain = RT.TableChain(t.spark, path, ["user_id"], "user_id bigint", ["ts", "event_id"], "event_type", condition, ids)
    run.run_batches(_typed_stream(t), chain.handler(dedup.batch_store(t.spark, out), steps), "chain")
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type")


register("str_02_table_upsert", lambda t: _table_chain(t), UPSERTS)
register("str_03_realtime_chain", lambda t: _table_chain(t, ".value > 4"),
         TYPED.replace("FROM events), seen", "FROM events WHERE value > 4), seen") +
         """ SELECT event_id, user_id, CASE WHEN event_type = 'UPDATE' AND (previous IS NULL OR previous = 'DELETE')
             THEN 'CREATE' ELSE event_type END AS event_type FROM seen""")

# A filter on the rewritten type: an UPDATE passes only as the first of its entity, i.e. as a CREATE.
CREATED_ONLY = """
    WITH typed AS (SELECT *, CASE event_type WHEN 'view' THEN 'CREATE' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE'
                             ELSE event_type END AS kind FROM events),
         seen AS (SELECT *, last_value(CASE WHEN kind IN ('CREATE', 'UPDATE', 'DELETE') THEN kind END IGNORE NULLS)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM typed)
    SELECT event_id, user_id, CASE WHEN kind = 'UPDATE' THEN 'CREATE' ELSE kind END AS event_type FROM seen
    WHERE kind IN ('CREATE', 'DELETE') OR (kind = 'UPDATE' AND (previous IS NULL OR previous = 'DELETE'))"""
TYPE_FILTER = P.condition("event_type", "in", ["CREATE", "DELETE"])
register("str_03_chain_type_filter", lambda t: _table_chain(t, TYPE_FILTER), CREATED_ONLY)
register("str_03_chain_type_filter_stateful",
         lambda t: run.run_to_table(RT.realtime(_typed_stream(t), ["user_id"], ["ts", "event_id"], condition=TYPE_FILTER,
                                                id_field="event_id"), "chain", timers=True).select("event_id", "user_id", "event_type"),
         CREATED_ONLY)


def _whole(step: str) -> str:
    """All windows of the table."""
    return f"""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total
        FROM ({step}) GROUP BY ALL"""


def _windows(t: Tables, size: str, slide: str | None) -> DataFrame:
    """Windows of a stream in time order: closed by the watermark on the way, the last ones when the input ends."""
    stream = run.with_event_time(_events_in_time(t), "ts")
    table = WindowTable(t.spark, scratch_path(t.spark, "windows"), stream.schema, "ts", {"n": ("count", None), "total": ("sum", "value")},
                        ["event_type"], size, slide, "10 minutes")
    run.run_batches(stream, table.handle, "windows")
    return table.finish().select(F.date_format("window_start", TIME).alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


register("str_04_tumbling_window", lambda t: _windows(t, "1 hour", None),
         _whole("SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM events"))
register("str_05_sliding_window", lambda t: _windows(t, "2 hours", "1 hour"),
         _whole("SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM events UNION ALL "
                "SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR FROM events"))


@query("str_06_watermark_column", """
    WITH parts AS (SELECT *, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS part FROM events),
         tops AS (SELECT part, max(ts) AS top FROM parts GROUP BY part),
         marks AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 MINUTE AS mark FROM tops)
    SELECT user_id, count(*) FILTER (WHERE mark IS NULL OR ts >= mark) AS n, count(*) FILTER (WHERE ts < mark) AS late
    FROM parts JOIN marks USING (part) GROUP BY user_id""")
def _(t: Tables):
    """Events in the order of their ids, four batches: counts per key of rows that are on time, and of those that are late."""
    rows = t.events.select("event_id", "user_id", "ts")
    top = rows.agg(F.max("event_id")).first()[0]
    stream = run.with_event_time(_fed(t, rows, "by-id", F.floor(F.col("event_id") * BATCHES / F.lit((top or 0) + 1)).cast("int")), "ts")
    good, late = scratch_path(t.spark, "on-time"), scratch_path(t.spark, "late")
    split = LateRows(t.spark, scratch_path(t.spark, "split"), "ts", "5 minutes")
    run.run_batches(stream, split.handler(dedup.batch_store(t.spark, good), dedup.batch_store(t.spark, late)), "timed")
    counted = lambda path: t.spark.read.schema(stream.schema).parquet(path)
    both = counted(good).withColumn("is_late", F.lit(False)).unionByName(counted(late).withColumn("is_late", F.lit(True)))
    return both.groupBy("user_id").agg(F.count_if(~F.col("is_late")).alias("n"), F.count_if("is_late").alias("late"))


def _throttled(strategy: str, rate: int, burst: int):
    return lambda t: run.run_to_table(
        RT.throttle(_events_in_time(t), ["event_type"], "ts", "event_id", rate, "hour", burst, strategy), "throttled"
    ).select("event_id", "event_type")


register("str_07_throttle_fixed", _throttled("fixed_window", 2, 1),
         "SELECT event_id, event_type FROM events QUALIFY row_number() OVER "
         "(PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 3")
# Admission depends on the rows admitted before; tests compare these with a sequential model.
@query("str_07_throttle_fixed_table", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER "
       "(PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 3")
def _(t: Tables):
    out = scratch_path(t.spark, "throttled")
    table = RT.ThrottleTable(t.spark, scratch_path(t.spark, "limits"), ["event_type"], "ts", "event_id", 2, "hour", 1, "fixed_window")
    run.run_batches(_events_in_time(t), table.handler(dedup.batch_store(t.spark, out)), "throttle")
    return t.spark.read.parquet(out).select("event_id", "event_type")


register("str_07_throttle_sliding", _throttled("sliding_window", 2, 1))
register("str_07_throttle_token_bucket", _throttled("token_bucket", 2, 3))


@query("str_08_restart", "SELECT event_id, event_type FROM events")
def _(t: Tables):
    """Stop after the first half, restart from the checkpoint: nothing lost, nothing twice."""
    path, state, out = (scratch_path(t.spark, n) for n in ("feed", "state", "out"))
    rows = t.events.select("event_id", "event_type")
    rows.filter("event_type IN ('click', 'view')").write.parquet(path)
    stream = lambda: run.stream_table(t.spark, path, rows.schema)
    run.run_to_table(stream(), "out", state, out)
    rows.filter("event_type NOT IN ('click', 'view')").write.mode("append").parquet(path)
    return run.run_to_table(stream(), "out", state, out)


STAGES = {"stages": [
    {"type": "filter", "config": {"condition": ".event_type != 'view' && .value > 3"}},
    {"type": "transform", "config": {"lines": "kind = .event_type"}},
    {"type": "encrypt", "config": {"fields": ["event_type"], "method": "mask", "keep_first": 1}},
    {"type": "select", "config": {"fields": ["event_id", "kind", "event_type"]}},
]}
PARITY = "SELECT event_id, event_type AS kind, left(event_type, 1) || repeat('*', length(event_type) - 1) AS event_type FROM events WHERE event_type <> 'view' AND value > 3"
register("str_09_chain_as_batch", lambda t: dataflow.build(t.spark, STAGES, t.events), PARITY)
register("str_09_chain_as_stream", lambda t: run.run_to_table(dataflow.build(t.spark, STAGES, _stream(t)), "parity"), PARITY)


@query("str_10_latest_per_key", """
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t: Tables):
    newest = RT.latest(_events_in_time(t), ["user_id"], ["ts", "event_id"])
    table = RT.LatestTable(t.spark, scratch_path(t.spark, "latest"), newest.schema, ["user_id"])
    run.run_batches(newest, table.handle, "latest", mode="update")
    return table.current().select("user_id", "event_id", "event_type")


@query("str_11_progress", """
    SELECT count(*) AS input, count(*) FILTER (WHERE value > 5 AND event_type <> 'error') AS output,
           count(*) FILTER (WHERE value > 5 AND event_type = 'error') AS errors, count(*) FILTER (WHERE value <= 5) AS filtered FROM events""")
def _(t: Tables):
    from sluice.streaming.run import Progress, observed

    seen = Progress()
    t.spark.streams.addListener(seen)
    try:
        query_ = (observed(_stream(t).filter("value > 5"), F.col("event_type") == "error").writeStream.format("noop")
                  .option("checkpointLocation", scratch_path(t.spark, "progress")).trigger(availableNow=True).start())
        query_.awaitTermination()
        t.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        t.spark.streams.removeListener(seen)
    row = (seen.input, seen.output, seen.errors, seen.filtered)
    return t.spark.createDataFrame([row], "input bigint, output bigint, errors bigint, filtered bigint")


@query("str_12_bad_records_skipped", """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
           CASE WHEN event_type = 'error' THEN 'missing k' END AS _error FROM events""")
def _(t: Tables):
    text = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props"))
    parsed = _stream(t).select("event_id", F.try_variant_get(F.try_parse_json(text), "$.k", "bigint").alias("k"))
    return run.run_to_table(dataflow.error_column(parsed, ["k"]), "marked")


_STATES = """ SELECT 'physical' AS policy, id, seq, level, NULL AS mark FROM last WHERE __op <> 'd'
    UNION ALL SELECT 'ignore', id, seq, level, NULL FROM body
    UNION ALL SELECT policy, id, last.seq, body.level, CASE policy WHEN 'timestamp' THEN CASE WHEN last.__op = 'd' THEN CAST(last.seq AS VARCHAR) END
        WHEN 'boolean' THEN CAST(last.__op = 'd' AS VARCHAR) WHEN 'status' THEN CASE WHEN last.__op = 'd' THEN 'D' ELSE 'A' END
        ELSE CASE WHEN last.__op = 'd' THEN 'gone' ELSE 'live' END END
        FROM last LEFT JOIN body USING (id), (VALUES ('timestamp'), ('boolean'), ('status'), ('custom')) AS p(policy)"""


@query("cdc_11_stream_apply", LATEST + _STATES)
def _(t: Tables):
    """The change log in four batches, in order; every delete policy keeps its own table."""
    log = change_log(t)
    top = log.agg(F.max("seq")).first()[0]
    stream = _fed(t, log, "log", F.floor(F.col("seq") * BATCHES / F.lit((top or 0) + 1)).cast("int"))
    policies = {"physical": DeletePolicy("physical", **BY_OP), "ignore": DeletePolicy("ignore", **BY_OP),
                "timestamp": DeletePolicy("soft", "timestamp", "mark", **BY_OP), "boolean": DeletePolicy("soft", "boolean", "mark", **BY_OP),
                "status": DeletePolicy("soft", "status", "mark", **BY_OP), "custom": DeletePolicy("soft", "custom", "mark", "gone", "live", **BY_OP)}
    tables = {name: ChangeTable(t.spark, scratch_path(t.spark, name), log.schema, ["id"], ["seq"], policy, "seq", ["__op"], classes=2)
              for name, policy in policies.items()}

    def handle(batch: DataFrame, batch_id: int) -> None:
        for table in tables.values():
            table.handle(batch, batch_id)

    run.run_batches(stream, handle, "log")
    frames = [table.current().select(F.lit(name).alias("policy"), "id", "seq", "level",
                                         (F.col("mark").cast("string") if policies[name].field_name else F.lit(None).cast("string")).alias("mark"))
              for name, table in tables.items()]
    return X.union_sources(frames)


@query("agg_15_batch_latency", "SELECT true AS all_rows_seen, true AS positive")
def _(t: Tables):
    """Mean batch duration of a stream over the events, by the listener, which sees every batch."""
    seen = run.Progress()
    t.spark.streams.addListener(seen)
    query_ = (_stream(t).groupBy("event_type").count().writeStream.format("noop").outputMode("complete")
              .option("checkpointLocation", scratch_path(t.spark, "latency")).trigger(availableNow=True).start())
    query_.awaitTermination()
    t.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    t.spark.streams.removeListener(seen)
    mean = statistics.average_latency(seen.durations)
    return t.events.groupBy().agg((F.count(F.lit(1)) == F.lit(seen.input)).alias("all_rows_seen"), F.lit(mean > 0).alias("positive"))


@query("jon_01_stream_lookup", "SELECT event_id, r_name FROM events LEFT JOIN region ON r_regionkey = user_id % 7")
def _(t: Tables):
    keyed = _stream(t).select("event_id", (F.col("user_id") % 7).cast("int").alias("r_regionkey"))
    return run.run_to_table(X.lookup(keyed, t.region, ["r_regionkey"]), "joined").select("event_id", "r_name")


@query("set_01_stream_union", "SELECT event_id AS id FROM events UNION ALL SELECT o_orderkey FROM orders")
def _(t: Tables):
    both = X.union_sources([_stream(t).select(F.col("event_id").alias("id")), _stream(t, "orders").select(F.col("o_orderkey").alias("id"))])
    return run.run_to_table(both, "union")


@query("flt_27_sample_stream", "SELECT true AS within_range FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(t: Tables):
    from sluice.operators.routing import sample

    kept = run.run_to_table(sample(_stream(t, "lineitem").select("l_orderkey"), 0.5, 3), "sampled").select(F.lit(1).alias("kept"), F.lit(0).alias("total"))
    both = kept.unionByName(t.lineitem.select(F.lit(0).alias("kept"), F.lit(1).alias("total")))
    return both.agg((F.sum("kept") / F.sum("total")).between(0.4, 0.6).alias("within_range"))


@query("snk_10_fan_out_stream", """
    SELECT 'all' AS sink, event_id FROM events UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error'""")
def _(t: Tables):
    base = scratch_path(t.spark, "fan")
    sinks = [(None, lambda df, i: df.write.mode("overwrite").parquet(f"{base}/sink=all/batch={i}")),
             (".event_type == 'error'", lambda df, i: df.write.mode("overwrite").parquet(f"{base}/sink=errors/batch={i}"))]
    spec = {"stages": [{"type": "select", "config": {"fields": ["event_id", "event_type"]}}]}
    dataflow.run_stream(_stream(t), spec, sinks, scratch_path(t.spark, "fan-state")).awaitTermination()
    return t.spark.read.parquet(base).select("sink", "event_id")


register("prj_03_transform_stream",
         lambda t: run.run_to_table(S.transform(_stream(t).select("event_id", "event_type"), "kind = .event_type\nevent_type = 'x'"), "lines"),
         "SELECT event_id, event_type AS kind, 'x' AS event_type FROM events")
