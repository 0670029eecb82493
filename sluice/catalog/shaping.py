"""PRJ: record shaping; UDF-03."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query, register
from sluice.operators import predicates as P, shaping as S
from sluice.plans import dataflow

register("prj_01_select", lambda t: S.select(t.customer, ["c_custkey", "absent", "c_name"]),
         "SELECT c_custkey, c_name FROM customer")
register("prj_02_exclude", lambda t: S.exclude(t.customer, ["c_acctbal", "c_name", "absent"]),
         "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")


@query("prj_03_transform", """
    SELECT c_custkey, c_mktsegment AS c_name, c_name AS previous_name, 'fixed' AS origin, c_mktsegment FROM customer""")
def _(t: Tables):
    lines = """
        # a comment
        c_name = .c_mktsegment
        previous_name = .c_name
        origin = 'fixed'
        ignored = .absent
        also_ignored = upper(c_name)
    """
    return S.transform(t.customer, lines).drop("c_nationkey", "c_acctbal")


@query("prj_04_remap", """
    SELECT event_id, event_type AS k, event_type AS kind, event_type, '2024-02-01T00:00:00Z' AS processed_at,
           CASE WHEN user_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n
    FROM events""")
def _(t: Tables):
    number = F.regexp_extract("props", r"(\d+)", 1)
    body = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"k": "x", "n": '), number, F.lit("}"))).otherwise(F.lit("plain text"))
    rows = t.events.select("event_id", "event_type", body.alias("message"))
    out = S.remap(rows, {"kind": "event_type", "k": "event_type", "none": "absent"},
                  message_schema="k string, n bigint", processed_at=F.lit("2024-02-01T00:00:00Z"))
    return out.drop("message")


register("prj_05_rename_drop_unmapped",
         lambda t: S.rename(t.customer, {"c_custkey": "id", "c_name": "name", "absent": "x"}, drop_unmapped=True),
         "SELECT c_custkey AS id, c_name AS name FROM customer")
register("prj_05_rename", lambda t: S.rename(t.nation, {"n_name": "name"}),
         "SELECT n_nationkey, n_name AS name, n_regionkey FROM nation")
register("prj_06_enrich_fields",
         lambda t: S.enrich(t.customer, {"environment": "production", "c_mktsegment": "hidden", "version": 2}),
         "SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'hidden' AS c_mktsegment, 'production' AS environment, "
         "2 AS version FROM customer")
register("prj_07_enrich_tag", lambda t: S.enrich(t.orders.select("o_orderkey"), lookup_table="error_codes"),
         "SELECT o_orderkey, 'error_codes' AS enriched_from FROM orders")
register("prj_08_merge", lambda t: S.merge(t.part, ["p_brand", "p_type"], "label").select("p_partkey", "label"),
         "SELECT p_partkey, p_brand || ' ' || p_type AS label FROM part")
register("prj_08_merge_template",
         lambda t: S.merge(t.part, [], "label", pattern="{{p_brand}}/{{ p_size }}: {{p_name}}!").select("p_partkey", "label"),
         "SELECT p_partkey, p_brand || '/' || p_size || ': ' || p_name || '!' AS label FROM part")
register("prj_09_split",
         lambda t: S.split(t.pages, "url", r"^(https?)://([^/]+)/([a-z]+)/(\d+)\?", ["scheme", "host", "lang", "number"],
                           keep_original=False).drop("html"),
         r"""SELECT page_id, CASE WHEN ok THEN regexp_extract(url, p, 1) END AS scheme,
                    CASE WHEN ok THEN regexp_extract(url, p, 2) END AS host,
                    CASE WHEN ok THEN regexp_extract(url, p, 3) END AS lang,
                    CASE WHEN ok THEN regexp_extract(url, p, 4) END AS number
             FROM (SELECT *, '^(https?)://([^/]+)/([a-z]+)/(\d+)\?' AS p,
                          regexp_matches(url, '^(https?)://([^/]+)/([a-z]+)/(\d+)\?') AS ok FROM pages)""")
register("prj_10_sha256", lambda t: S.encrypt(t.customer.select("c_custkey", "c_name"), ["c_name"]),
         "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
register("prj_10_sha512", lambda t: S.encrypt(t.customer.select("c_custkey", "c_name"), ["c_name"], "sha512"))


@query("prj_11_aes_round_trip", "SELECT c_custkey, c_name, true AS hidden FROM customer")
def _(t: Tables):
    os.environ.setdefault("SLUICE_DEMO_KEY", "0123456789abcdef0123456789abcdef")
    rows = t.customer.select("c_custkey", "c_name", F.col("c_name").alias("secret"))
    sealed = S.encrypt(rows, ["secret"], "aes256", key_env="SLUICE_DEMO_KEY")
    hidden = F.col("secret") != F.col("c_name")
    return sealed.select("c_custkey", S.decrypt(F.col("secret"), "SLUICE_DEMO_KEY").alias("c_name"), hidden.alias("hidden"))


register("prj_12_mask",
         lambda t: S.encrypt(t.part.select("p_partkey", "p_name"), ["p_name"], "mask", keep_first=2, keep_last=6),
         "SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN left(p_name, 2) || repeat('*', length(p_name) - 8) "
         "|| right(p_name, 6) ELSE repeat('*', length(p_name)) END AS p_name FROM part")


def _with_gaps(t: Tables):
    kind = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.nullif("event_type", F.lit("error")))
    return t.events.select("event_id", kind.alias("kind"))


register("prj_13_default_null", lambda t: S.default(_with_gaps(t), {"kind": "unknown", "level": "info"}),
         "SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN 'unknown' ELSE event_type END AS kind, "
         "'info' AS level FROM events")
register("prj_13_default_empty", lambda t: S.default(_with_gaps(t), {"kind": "unknown"}, only_null=False),
         "SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 'unknown' ELSE event_type END AS kind FROM events")


def _texts(t: Tables):
    """Text fields that partly convert."""
    number = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return t.events.select(
        "event_id", number.alias("n"), F.col("value").cast("string").alias("f"),
        F.when(F.col("user_id") % 2 == 0, "true").otherwise("no idea").alias("b"),
        F.date_format("ts", "yyyy/MM/dd").alias("d"), "user_id")


K = "json_extract_string(props, '$.k')"
register("prj_14_cast_null",
         lambda t: S.cast(_texts(t), {"n": "int", "f": "float", "b": "bool", "d": "date", "user_id": "string"},
                          date_format="2006/01/02").withColumn("d", F.date_format("d", "yyyy-MM-dd")),
         f"SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST({K} AS BIGINT) END AS n, value AS f, "
         "CASE WHEN user_id % 2 = 0 THEN true END AS b, strftime(ts, '%Y-%m-%d') AS d, "
         "CAST(user_id AS VARCHAR) AS user_id FROM events")
register("prj_14_cast_drop", lambda t: S.cast(_texts(t).select("event_id", "n"), {"n": "int"}, on_error="drop"),
         f"SELECT event_id, CAST({K} AS BIGINT) AS n FROM events WHERE event_type <> 'error'")
register("prj_14_cast_keep", lambda t: S.cast(_texts(t).select("event_id", "n"), {"n": "int"}, on_error="keep"),
         f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE {K} END AS n FROM events")

register("prj_15_timestamp_add",
         lambda t: S.timestamp(t.orders.select("o_orderkey"), "add", "at")
         .select("o_orderkey", F.col("at").isNotNull().alias("stamped")),
         "SELECT o_orderkey, true AS stamped FROM orders")
register("prj_16_timestamp_convert",
         lambda t: S.timestamp(t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("raw")),
                               "convert", "seoul", "raw", "Asia/Seoul", "2006-01-02 15:04:05")
         .select("event_id", F.date_format("seoul", "yyyy-MM-dd HH:mm:ss").alias("seoul")),
         "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS seoul FROM events")
register("prj_17_timestamp_format",
         lambda t: S.timestamp(t.orders, "format", "day", "o_orderdate", output_format="02/01/2006 15:04")
         .select("o_orderkey", "day"),
         "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS day FROM orders")
register("prj_18_passthrough", lambda t: S.passthrough(t.region), "SELECT * FROM region")
register("prj_19_step_chain",
         lambda t: S.step(t.orders, "status = .o_orderstatus\nkind = 'order'", ".status == 'F' && .o_totalprice > 200000",
                          1.0, ["o_orderkey", "status", "kind", "o_custkey"], ["o_custkey"]),
         "SELECT o_orderkey, o_orderstatus AS status, 'order' AS kind FROM orders "
         "WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
register("prj_20_json_parse",
         lambda t: S.json_parse(t.events.select("event_id", F.col("props").alias("message")))
         .select("event_id", F.try_variant_get("rec", "$.k", "bigint").alias("k")),
         f"SELECT event_id, CAST({K} AS BIGINT) AS k FROM events")
register("prj_21_partition_keys", lambda t: S.partition_keys(t.events, "ts").select("event_id", "_partition_date", "_partition_hour"),
         "SELECT event_id, strftime(ts, '%Y-%m-%d') AS _partition_date, strftime(ts, '%H') AS _partition_hour FROM events")
register("prj_22_derive",
         lambda t: S.derive(t.orders, "amount_category",
                            [(P.condition("o_totalprice", "gt", 300000), "high"), (P.condition("o_totalprice", "gt", 100000), "medium")],
                            "low").select("o_orderkey", "amount_category"),
         "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' "
         "ELSE 'low' END AS amount_category FROM orders")


@query("udf_03_custom_stage", """
    SELECT c_custkey, c_acctbal * 2 AS doubled FROM customer WHERE c_acctbal > 0""")
def _(t: Tables):
    dataflow.register_stage("double_balance", lambda df, floor=0: df.filter(F.col("c_acctbal") > floor)
                            .select("c_custkey", (F.col("c_acctbal") * 2).alias("doubled")))
    return dataflow.build(t.spark, {"stages": [{"type": "double_balance", "config": {"floor": 0}}]}, t.customer)


@query("udf_03_row_stage", "SELECT doc_id, length(text) AS letters FROM documents WHERE n_chars >= 0")
def _(t: Tables):
    def rows(frames):
        for pdf in frames:
            yield pdf.assign(letters=pdf["text"].str.len())[["doc_id", "letters"]]

    dataflow.register_row_stage("count_letters", rows, "doc_id bigint, letters bigint")
    stages = [{"type": "filter", "config": {"condition": ".n_chars >= 0"}}, {"type": "count_letters"}]
    return dataflow.build(t.spark, {"stages": stages}, t.documents.select("doc_id", "text", "n_chars"))
