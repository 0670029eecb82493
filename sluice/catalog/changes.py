"""WIN and CDC: de-duplication, upserts, throttling, change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query, register
from sluice.operators import changes as H, routing as R
from sluice.operators.throttling import throttle


def with_copies(t: Tables):
    """Events, with a later copy of every third one."""
    again = t.events.filter("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    return t.events.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))


COPIES = """WITH copies AS (SELECT *, 0 AS copy FROM events
            UNION ALL SELECT * REPLACE (ts + INTERVAL 2 HOUR AS ts), 1 FROM events WHERE event_id % 3 = 0)"""


def _pick(order: str) -> str:
    return f"{COPIES} SELECT event_id, copy, user_id FROM copies QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {order}) = 1"


KEEP = ["event_id", "copy", "user_id"]
register("win_01_keep_first", lambda t: H.dedupe(with_copies(t), ["user_id"], ["event_id", "copy"], "keep_first").select(KEEP),
         _pick("event_id, copy"))
register("win_01_keep_last", lambda t: H.dedupe(with_copies(t), ["user_id"], ["event_id", "copy"], "keep_last").select(KEEP),
         _pick("event_id DESC, copy DESC"))
register("win_01_keep_latest",
         lambda t: H.dedupe(with_copies(t), ["user_id"], ["event_id", "copy"], "keep_latest", "ts").select(KEEP),
         _pick("ts DESC, event_id DESC, copy DESC"))


def typed_events(t: Tables):
    """Events as CREATE, UPDATE, DELETE and other types of the entity ``user_id``."""
    kinds = {"view": "CREATE", "click": "UPDATE", "error": "DELETE"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return t.events.withColumn("event_type", F.coalesce(F.element_at(table, F.col("event_type")), F.col("event_type")))


TYPED = """WITH typed AS (SELECT * REPLACE (CASE event_type WHEN 'view' THEN 'CREATE' WHEN 'click' THEN 'UPDATE'
                WHEN 'error' THEN 'DELETE' ELSE event_type END AS event_type) FROM events), seen AS (
            SELECT *, last_value(CASE WHEN event_type IN ('CREATE', 'UPDATE', 'DELETE') THEN event_type END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM typed)"""
UPSERTS = TYPED + """ SELECT event_id, user_id, CASE WHEN event_type = 'UPDATE' AND (previous IS NULL OR previous = 'DELETE')
            THEN 'CREATE' ELSE event_type END AS event_type FROM seen"""

register("win_03_upsert_conversion",
         lambda t: H.convert_upserts(typed_events(t).drop("props", "value"), ["user_id"], ["ts", "event_id"])
         .select("event_id", "user_id", "event_type"), UPSERTS)
register("win_03_upsert_with_known_entities",
         lambda t: H.convert_upserts(typed_events(t).drop("props", "value"), ["user_id"], ["ts", "event_id"],
                                     existing=t.events.select("user_id").filter("user_id % 2 = 0"))
         .select("event_id", "user_id", "event_type"),
         TYPED + """ SELECT event_id, user_id, CASE WHEN event_type = 'UPDATE' AND (previous = 'DELETE' OR
            (previous IS NULL AND user_id % 2 <> 0)) THEN 'CREATE' ELSE event_type END AS event_type FROM seen""")

# Acceptance depends on the last accepted row, which recursion over whole tables makes too slow in SQL.
register("win_04_dedupe_within",
         lambda t: H.dedupe_within(t.events, ["user_id"], "ts", "event_id", 24 * 3600).select("event_id", "user_id"))
register("win_05_throttle_fixed",
         lambda t: H.throttle_fixed(t.events, ["event_type"], "ts", "event_id", 2, "hour", burst=1).select("event_id", "event_type"),
         "SELECT event_id, event_type FROM events QUALIFY row_number() OVER "
         "(PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 3")
register("win_05_throttle_large_rate",
         lambda t: H.throttle_fixed(t.events.drop("props"), ["event_type"], "ts", "event_id", 1200, "month", burst=10)
         .select("event_id", "event_type"),
         "SELECT event_id, event_type FROM events QUALIFY row_number() OVER "
         "(PARTITION BY event_type, date_trunc('month', ts) ORDER BY ts, event_id) <= 1210")
register("win_05_throttle_fixed_one_pass",
         lambda t: throttle(t.events.drop("props"), ["event_type"], "ts", "event_id", 2, "hour", 1, "fixed_window")
         .select("event_id", "event_type"),
         "SELECT event_id, event_type FROM events QUALIFY row_number() OVER "
         "(PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 3")
# Which rows these admit depends on the rows admitted before; tests compare them with a model.
register("win_05_throttle_sliding",
         lambda t: throttle(t.events.drop("props"), ["event_type"], "ts", "event_id", 2, "hour", 1, "sliding_window")
         .select("event_id", "event_type"))
register("win_05_throttle_token_bucket",
         lambda t: throttle(t.events.drop("props"), ["event_type"], "ts", "event_id", 2, "hour", 3, "token_bucket")
         .select("event_id", "event_type"))


# -- change logs -------------------------------------------------------------------------

def change_log(t: Tables):
    """Orders as a change log of customers: status F inserts, O updates, P deletes."""
    gone = F.col("o_orderstatus") == "P"
    return t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.when(gone, "d").when(F.col("o_orderstatus") == "O", "u").otherwise("c").alias("__op"),
        F.when(~gone, F.col("o_orderpriority")).alias("level"),
        F.when(~gone, F.col("o_totalprice")).alias("amount"),
    )


LOG = """WITH log AS (SELECT o_custkey AS id, o_orderkey AS seq,
            CASE o_orderstatus WHEN 'P' THEN 'd' WHEN 'O' THEN 'u' ELSE 'c' END AS __op,
            CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS level,
            CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount FROM orders)"""
LATEST = LOG + """, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
            body AS (SELECT * FROM log WHERE __op <> 'd' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""

BODY = H.DeletePolicy("soft", "boolean", "gone")
FLAG = H.DeletePolicy("soft", "boolean", "gone", method="flag_field", detect_field="level", detect_value="5-LOW")
TYPE = H.DeletePolicy("soft", "boolean", "gone", method="event_type", detect_field="__op", detect_value="d")


def _flagged(policy: H.DeletePolicy):
    return lambda t: H.mark_deletes(change_log(t), policy, ["id"], ignored=["seq", "__op"]).select("seq", "gone")


register("cdc_01_detect_null_body", _flagged(BODY), LOG + " SELECT seq, level IS NULL AND amount IS NULL AS gone FROM log")
register("cdc_02_detect_flag_field", _flagged(FLAG), LOG + " SELECT seq, coalesce(level = '5-LOW', false) AS gone FROM log")
register("cdc_03_detect_event_type", _flagged(TYPE), LOG + " SELECT seq, __op = 'd' AS gone FROM log")

ENVELOPE = ["__op"]


BY_OP = {"method": "event_type", "detect_field": "__op", "detect_value": "d"}
register("cdc_04_physical", lambda t: H.apply_changes(change_log(t), ["id"], ["seq"], H.DeletePolicy("physical", **BY_OP), envelope=ENVELOPE),
         LATEST + " SELECT id, seq, level, amount FROM last WHERE __op <> 'd'")


def _soft(field_type: str, name: str, deleted: str | None = None, active: str | None = None):
    policy = H.DeletePolicy("soft", field_type, name, deleted, active, **BY_OP)
    return lambda t: H.apply_changes(change_log(t), ["id"], ["seq"], policy, "seq", ENVELOPE)


def _soft_sql(expression: str) -> str:
    return LATEST + f" SELECT id, last.seq, body.level, body.amount, {expression} FROM last LEFT JOIN body USING (id)"


register("cdc_05_soft_timestamp", _soft("timestamp", "deleted_at"), _soft_sql("CASE WHEN last.__op = 'd' THEN last.seq END AS deleted_at"))
register("cdc_06_soft_boolean", _soft("boolean", "is_deleted"), _soft_sql("last.__op = 'd' AS is_deleted"))
register("cdc_07_soft_status", _soft("status", "status"), _soft_sql("CASE WHEN last.__op = 'd' THEN 'D' ELSE 'A' END AS status"))
register("cdc_08_soft_custom", _soft("custom", "state", "gone", "live"), _soft_sql("CASE WHEN last.__op = 'd' THEN 'gone' ELSE 'live' END AS state"))
register("cdc_09_ignore", lambda t: H.apply_changes(change_log(t), ["id"], ["seq"], H.DeletePolicy("ignore", **BY_OP), envelope=ENVELOPE),
         LATEST + " SELECT id, seq, level, amount FROM body")
register("cdc_10_preset_cdc_soft_timestamp",
         lambda t: H.apply_changes(change_log(t), ["id"], ["seq"], H.PRESETS["cdc_soft_timestamp"], "seq", ENVELOPE),
         _soft_sql("CASE WHEN last.__op = 'd' THEN last.seq END AS deleted_at"))


@query("cdc_10_presets", LOG + " SELECT name, count(*) AS rows_out, "
       "CAST(sum(CASE WHEN name IN ('soft_boolean', 'soft_status', 'soft_timestamp', 'cdc_soft_timestamp') AND __op = 'd' THEN 1 ELSE 0 END) AS BIGINT) AS marked "
       "FROM log, (VALUES ('physical'), ('soft_timestamp'), ('soft_boolean'), ('soft_status'), ('cdc_soft_timestamp'), ('ignore')) AS p(name) "
       "WHERE NOT (name = 'physical' AND __op = 'd') AND NOT (name = 'ignore' AND level IS NULL) GROUP BY name")
def _(t: Tables):
    def one(name: str, policy: H.DeletePolicy):
        out = H.mark_deletes(change_log(t), policy, ["id"], ts="seq", ignored=["seq", "__op"])
        field = policy.field_name
        marks = F.lit(0) if field is None else F.when(
            F.col(field).cast("string").isin("true", "D") | (F.lit(policy.field_type == "timestamp") & F.col(field).isNotNull()), 1).otherwise(0)
        return out.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows_out"), F.sum(marks).alias("marked"))

    frames = [one(name, policy) for name, policy in H.PRESETS.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


register("cdc_11_apply_composite_key",
         lambda t: H.apply_changes(change_log(t).withColumn("part", F.col("seq") % 3), ["id", "part"], ["seq"],
                                   H.DeletePolicy("physical", **BY_OP), envelope=ENVELOPE),
         LOG + " SELECT id, part, seq, level, amount FROM (SELECT *, seq % 3 AS part FROM log) "
         "QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY seq DESC) = 1 AND __op <> 'd'")


@query("cdc_12_changed_fields", """
    SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'X' AND o_orderkey % 2 = 0 THEN 'status' END,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'level' END) AS changed FROM orders""")
def _(t: Tables):
    old = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("level"))
    new = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status"),
                   F.nullif("o_orderpriority", F.lit("5-LOW")).alias("level"))
    rows = t.orders.select("o_orderkey", old.alias("_old_data"), new.alias("_new"))
    changed = H.changed_fields(rows, "_new", "_old_data")
    return rows.select("o_orderkey", F.array_join(F.transform(changed, lambda c: c["field"]), ",").alias("changed"))


@query("cdc_13_split_flows", LOG + " SELECT seq, CASE WHEN __op = 'd' THEN 'delete_flow' ELSE 'upsert_flow' END AS _route FROM log")
def _(t: Tables):
    routes = [{"match": ["c", "u"], "target": "upsert_flow"}, {"match": ["d"], "target": "delete_flow"}]
    return R.route_by_value(change_log(t), "__op", routes).select("seq", "_route")
