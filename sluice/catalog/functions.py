"""FN: column functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query, register
from sluice.functions import scalars as S

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

register("fn_01_parse_json",
         lambda t: t.events.select("event_id", S.parse_json(F.col("props"), "k bigint")["k"].alias("k")),
         f"SELECT event_id, {K} AS k FROM events")
register("fn_02_rfc3339", lambda t: t.orders.select("o_orderkey", S.rfc3339(F.col("o_orderdate").cast("timestamp")).alias("at")),
         "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
register("fn_03_dated_name", lambda t: t.events.select("event_id", S.dated_name("logs-", F.col("ts")).alias("name")),
         "SELECT event_id, 'logs-' || strftime(ts, '%Y-%m-%d') AS name FROM events")
register("fn_04_text_functions",
         lambda t: t.part.select("p_partkey", F.col("p_name").contains("ring").alias("has_ring"),
                                 F.concat(F.lit("part "), F.col("p_size").cast("string")).alias("label")),
         "SELECT p_partkey, contains(p_name, 'ring') AS has_ring, 'part ' || p_size AS label FROM part")
register("fn_05_choose",
         lambda t: t.events.select("event_id", S.choose((F.col("event_type") == "error", "high"),
                                                        (F.col("value") > 10, "medium"), otherwise="low").alias("priority")),
         "SELECT event_id, CASE WHEN event_type = 'error' THEN 'high' WHEN value > 10 THEN 'medium' ELSE 'low' END AS priority "
         "FROM events")


@query("fn_06_env", "SELECT r_regionkey, 'eu' AS site, 'fallback' AS other FROM region")
def _(t: Tables):
    os.environ["SLUICE_DEMO_SITE"] = "eu"
    return t.region.select("r_regionkey", S.env("SLUICE_DEMO_SITE").alias("site"), S.env("SLUICE_UNSET", "fallback").alias("other"))


register("fn_07_regex_groups",
         lambda t: t.pages.select("page_id", *[c.alias(n) for n, c in S.regex_groups(
             F.col("url"), r"^(?P<scheme>https?)://(?P<host>[^/]+)/(?P<lang>[a-z]{2})/").items()]),
         r"""SELECT page_id, CASE WHEN ok THEN regexp_extract(url, p, 1) END AS scheme,
                    CASE WHEN ok THEN regexp_extract(url, p, 2) END AS host,
                    CASE WHEN ok THEN regexp_extract(url, p, 3) END AS lang
             FROM (SELECT *, '^(https?)://([^/]+)/([a-z]{2})/' AS p,
                          regexp_matches(url, '^(https?)://([^/]+)/([a-z]{2})/') AS ok FROM pages)""")


@query("fn_08_common_log", """
    SELECT event_id, '10.0.0.' || user_id AS host, '-' AS identity, 'user' || user_id AS "user",
           strftime(ts, '%d/%m/%Y:%H:%M:%S') || ' +0000' AS timestamp, 'GET /' || event_type || ' HTTP/1.1' AS request,
           '200' AS status, CAST(event_id AS VARCHAR) AS size FROM events""")
def _(t: Tables):
    line = F.format_string('10.0.0.%d - user%d [%s +0000] "GET /%s HTTP/1.1" 200 %d', "user_id", "user_id",
                           F.date_format("ts", "dd/MM/yyyy:HH:mm:ss"), "event_type", "event_id")
    rows = t.events.select("event_id", line.alias("line"))
    return rows.select("event_id", *[c.alias(n) for n, c in S.common_log(F.col("line")).items()])


register("fn_09_delete_field", lambda t: t.nation.drop("n_regionkey"), "SELECT n_nationkey, n_name FROM nation")


@query("fn_10_random_fields", """
    SELECT event_id, true AS id_ok, true AS number_ok, ['a', 'b', 'c'][event_id % 3 + 1] AS picked FROM events""")
def _(t: Tables):
    rows = t.events.select("event_id", F.uuid().alias("u"), S.random_int(100, 3).alias("n"),
                           S.pick(["a", "b", "c"], F.col("event_id")).alias("picked"))
    return rows.select("event_id", F.col("u").rlike("^[0-9a-f-]{36}$").alias("id_ok"),
                       F.col("n").between(0, 99).alias("number_ok"), "picked")


@query("fn_11_missing_field_error", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing kind' END AS _error FROM events""")
def _(t: Tables):
    from sluice.plans.dataflow import error_column

    rows = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return error_column(rows, ["event_id", "kind"]).select("event_id", "_error")


register("fn_11_require", lambda t: t.customer.select("c_custkey", S.require(F.col("c_name"), "no name").alias("name")),
         "SELECT c_custkey, c_name AS name FROM customer")


def _document():
    """``{"items": [{"name": type, "n": value}], "user": id}`` as a VARIANT."""
    item = F.struct(F.col("event_type").alias("name"), F.col("value").alias("n"))
    return F.parse_json(F.to_json(F.struct(F.array(item).alias("items"), F.col("user_id").alias("user"))))


register("fn_12_json_path",
         lambda t: t.events.select("event_id", S.json_path(_document(), "items.0.name").alias("name"),
                                   S.json_path(_document(), "user").alias("user_text"),
                                   S.json_path(_document(), "items.1.name").alias("absent"),
                                   S.json_path(_document(), "items.3.name", "none").alias("fallback")),
         "SELECT event_id, event_type AS name, CAST(user_id AS VARCHAR) AS user_text, '' AS absent, 'none' AS fallback FROM events")
register("fn_13_query_path",
         lambda t: t.events.select("event_id", F.try_variant_get(S.query_path(_document(), ".items[0].n"), "$", "double").alias("n")),
         "SELECT event_id, value AS n FROM events")
register("fn_14_template",
         lambda t: t.events.select("event_id", S.template('u={{user_id}} t={{ .event_type }} j=${!json("event_id")}.').alias("line")),
         "SELECT event_id, 'u=' || user_id || ' t=' || event_type || ' j=' || event_id || '.' AS line FROM events")
register("fn_15_epoch_millis", lambda t: t.events.select("event_id", S.epoch_millis(F.col("ts")).alias("ms")),
         "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
register("fn_16_hour", lambda t: t.events.select("event_id", F.date_format(S.hour_of(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("hour")),
         "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events")
register("fn_17_bytes_to_text",
         lambda t: t.customer.select("c_custkey", S.bytes_to_text(F.encode("c_name", "UTF-8")).alias("name")),
         "SELECT c_custkey, c_name AS name FROM customer")
register("fn_18_within_last",
         lambda t: t.events.filter(S.within_last(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 7)).select("event_id"),
         "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
register("fn_19_record_json",
         lambda t: t.nation.select("n_nationkey", S.record_json(t.nation).alias("line")),
         """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line
            FROM nation""")
