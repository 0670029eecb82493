"""FLT: predicates, routes and samples; UDF-01/02."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query, register
from sluice.operators import predicates as P, routing as R

C = P.condition


def _filtered(name: str, table: str, spec, columns: list[str], where: str) -> None:
    """Filter a table and keep some columns; the SQL is the same WHERE by hand."""
    register(name, lambda t: P.where(getattr(t, table), spec).select(*columns),
             f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")


CUSTOMER = ["c_custkey", "c_mktsegment", "c_nationkey"]
ORDER = ["o_orderkey", "o_orderpriority", "o_totalprice"]

_filtered("flt_01_eq", "customer", P.any_of(C("c_mktsegment", "eq", "BUILDING"), C("c_nationkey", "eq", "5")),
          CUSTOMER, "c_mktsegment = 'BUILDING' OR c_nationkey = 5")
_filtered("flt_03_gt", "orders", P.all_of(C("o_totalprice", "gt", 250000), C("o_orderpriority", "gt", "2-HIGH")),
          ORDER, "o_totalprice > 250000 AND o_orderpriority > '2-HIGH'")
_filtered("flt_04_gte", "lineitem", C("l_quantity", "gte", "45"), ["l_orderkey", "l_linenumber", "l_quantity"],
          "l_quantity >= 45")
_filtered("flt_05_lt", "lineitem", P.all_of(C("l_discount", "lt", 0.02), C("l_shipdate", "lt", "1998-01-01")),
          ["l_orderkey", "l_linenumber", "l_discount"],
          "l_discount < 0.02 AND strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') < '1998-01-01'")
_filtered("flt_06_lte", "part", C("p_size", "lte", 10), ["p_partkey", "p_size"], "p_size <= 10")
_filtered("flt_07_contains", "documents", P.any_of(C("text", "contains", "the "), C("n_chars", "contains", "77")),
          ["doc_id", "lang"], "contains(text, 'the ') OR contains(CAST(n_chars AS VARCHAR), '77')")
_filtered("flt_08_startswith", "part", C("p_name", "startswith", "blue"), ["p_partkey", "p_name"],
          "starts_with(p_name, 'blue')")
_filtered("flt_09_endswith", "customer", C("c_name", "endswith", "7"), ["c_custkey", "c_name"], "c_name LIKE '%7'")
_filtered("flt_10_regex", "pages", C("url", "regex", r"page=\d+"), ["page_id", "url"],
          r"regexp_matches(url, 'page=\d+')")
_filtered("flt_11_in", "orders", P.all_of(C("o_orderstatus", "in", ["F", "P"]), C("o_custkey", "in", [1, 2, 3, 5, 8, "13"])),
          ["o_orderkey", "o_custkey", "o_orderstatus"],
          "o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 5, 8, 13)")
_filtered("flt_17_groups", "events",
          P.all_of(C("value", "gt", 5), P.any_of(C("event_type", "eq", "click"),
                                                 P.all_of(C("event_type", "eq", "view"), C("user_id", "lt", 50)))),
          ["event_id", "event_type", "user_id"],
          "value > 5 AND (event_type = 'click' OR (event_type = 'view' AND user_id < 50))")
_filtered("flt_19_string_condition", "events",
          ".event_type == 'click' && .value >= 5 || (.user_id < '20' && .event_type ~= '^(sign|pur)') && .props exists",
          ["event_id", "event_type", "user_id"],
          "(event_type = 'click' AND value >= 5) OR ((user_id < 20 AND regexp_matches(event_type, '^(sign|pur)')) "
          "AND props IS NOT NULL)")
_filtered("flt_20_empty_filter", "nation", {}, ["n_nationkey", "n_name"], "true")


@query("flt_02_neq", """
    SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'error') AS kind FROM events) WHERE kind <> 'view'""")
def _(t: Tables):
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return P.where(rows, C("kind", "neq", "view"))


@query("flt_02_neq_missing_passes", """
    SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'error') AS kind FROM events)
    WHERE kind IS NULL OR kind <> 'view'""")
def _(t: Tables):
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return P.where(rows, C("kind", "neq", "view"), missing_passes=True)


@query("flt_03_gt_numeric_text", """
    SELECT event_id, k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
    WHERE TRY_CAST(k AS DOUBLE) > 9""")
def _(t: Tables):
    return P.where(t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")), C("k", "gt", 9))


@query("flt_12_notin", """
    SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'error') AS kind FROM events)
    WHERE kind NOT IN ('view', 'click')""")
def _(t: Tables):
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return P.where(rows, C("kind", "notin", ["view", "click"]))


def _records(t: Tables):
    """Schemaless records in which ``k`` is absent, null or a number."""
    text = (F.when(F.col("event_type") == "view", F.lit("{}"))
            .when(F.col("event_type") == "click", F.lit('{"k": null}')).otherwise(F.col("props")))
    return t.events.select("event_id", F.parse_json(text).alias("rec"))


for _name, _op, _where in [
    ("flt_13_exists", "exists", "event_type <> 'view'"),
    ("flt_14_notexists", "notexists", "event_type = 'view'"),
    ("flt_15_null", "null", "event_type IN ('view', 'click')"),
    ("flt_16_notnull", "notnull", "event_type NOT IN ('view', 'click')"),
]:
    register(_name, lambda t, op=_op: P.where(_records(t), C("k", op), variant="rec").select("event_id"),
             f"SELECT event_id FROM events WHERE {_where}")

register("flt_03_gt_variant", lambda t: P.where(_records(t), C("k", "gt", 50), variant="rec").select("event_id"),
         "SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click') "
         "AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")


@query("flt_18_nested_path", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id >= 10")
def _(t: Tables):
    user = F.struct(F.struct(F.col("event_type").alias("name")).alias("profile"), F.col("user_id").alias("id"))
    rows = t.events.select("event_id", user.alias("user"))
    return P.where(rows, P.all_of(C("user.profile.name", "eq", "click"), C(".user..id", "gte", 10))).select("event_id")


@query("flt_21_checked_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 100000.5")
def _(t: Tables):
    spec = {"root": P.all_of(C("o_orderstatus", "eq", "F"), C("o_totalprice", "lte", 100000.5))}
    P.check_filter(spec)
    return P.where(t.orders, spec).select("o_orderkey")


REPORT = P.all_of(C("event_type", "in", ["click", "purchase"]), C("value", "gt", 10))


@query("flt_22_filter_report", """
    SELECT event_id, event_type IN ('click', 'purchase') AND value > 10 AS passed FROM events""")
def _(t: Tables):
    return P.report_rows(t.events, REPORT).select("event_id", "passed")


@query("agg_14_pass_fail_summary", """
    SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed
    FROM (SELECT event_type IN ('click', 'purchase') AND value > 10 AS ok FROM events)""")
def _(t: Tables):
    return P.report_summary(t.events, REPORT)


ROUTES = [(C("event_type", "eq", "error"), "alerts"), (C("value", "gt", 20), "large"), (C("value", "gt", 5), "medium")]


@query("flt_23_route_first", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'alerts' WHEN value > 20 THEN 'large'
                          WHEN value > 5 THEN 'medium' ELSE 'rest' END AS _route FROM events""")
def _(t: Tables):
    return R.route_first(t.events, ROUTES, default="rest").select("event_id", "_route")


@query("flt_23_route_first_no_default", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'alerts' WHEN value > 20 THEN 'large' ELSE 'medium' END AS _route
    FROM events WHERE event_type = 'error' OR value > 5""")
def _(t: Tables):
    return R.route_first(t.events, ROUTES).select("event_id", "_route")


@query("flt_24_route_all", """
    SELECT event_id, 'alerts' AS _route FROM events WHERE event_type = 'error'
    UNION ALL SELECT event_id, 'large' FROM events WHERE value > 20
    UNION ALL SELECT event_id, 'medium' FROM events WHERE value > 5""")
def _(t: Tables):
    return R.route_all(t.events.select("event_id", "event_type", "value"), ROUTES).select("event_id", "_route")


@query("flt_24_copy_to_all", """
    SELECT event_id, _route FROM events, (VALUES ('a'), ('b'), ('c')) AS o(_route)""")
def _(t: Tables):
    return R.copy_to_all(t.events.select("event_id"), ["a", "b", "c"])


@query("flt_25_route_by_value", """
    SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'upserts' ELSE 'deletes' END AS _route
    FROM events WHERE event_type IN ('signup', 'purchase', 'error')""")
def _(t: Tables):
    routes = [{"match": ["signup", "purchase"], "target": "upserts"}, {"match": ["error"], "target": "deletes"}]
    return R.route_by_value(t.events, "event_type", routes).select("event_id", "_route")


@query("flt_26_round_robin", """
    SELECT event_id, CASE (row_number() OVER (ORDER BY ts, event_id) - 1) % 3
                     WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS _route FROM events""")
def _(t: Tables):
    rows = t.events.select("event_id", "ts")
    return R.round_robin(rows, ["a", "b", "c"], [F.col("ts"), F.col("event_id")]).select("event_id", "_route")


@query("flt_27_sample_by_key", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE ((l_orderkey * 8 + l_linenumber) % 1000000 * 2654435761) % 1000000 < 100000""")
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return R.sample_by_key(rows, F.col("l_orderkey") * 8 + F.col("l_linenumber"), 0.1)


@query("flt_27_sample", "SELECT true AS within_range")
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey")
    kept = R.sample(rows, 0.5, seed=7).select(F.lit(1).alias("kept"), F.lit(0).alias("total"))
    both = kept.unionByName(rows.select(F.lit(0).alias("kept"), F.lit(1).alias("total")))
    return both.agg((F.sum("kept") / F.sum("total")).between(0.4, 0.6).alias("within_range"))


@query("flt_28_discriminator", """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'model_b' ELSE 'model_m' END AS _model
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def _(t: Tables):
    models = {"BUILDING": "model_b", "MACHINERY": "model_m"}
    return R.route_to_models(t.customer, "c_mktsegment", models).select("c_custkey", "_model")


@query("flt_29_time_range", """
    SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-17 12:30:00'""")
def _(t: Tables):
    start, end = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-10 00:00:00", "2024-01-17 12:30:00"))
    return t.events.filter(P.in_time_range(F.col("ts"), start, end)).select("event_id")


# -- custom operators --------------------------------------------------------------------

def _divisible(f, value):
    return f.number % F.lit(float(value)) == 0


def _custom(name: str, build) -> None:
    if name not in P._custom:
        P.register_operator(name, build)


_custom("divisible_by", _divisible)
for _build in (P.ip_in_range, P.date_after, P.date_before, P.jsonpath_exists):
    _custom(_build.__name__, _build)


register("udf_01_custom_operator",
         lambda t: P.where(t.events, P.all_of(C("user_id", "divisible_by", 7), C("value", "gt", 3))).select("event_id"),
         "SELECT event_id FROM events WHERE user_id % 7 = 0 AND value > 3")


@query("udf_02_ip_in_range", """
    SELECT event_id FROM events WHERE user_id % 4 = 1 AND event_id % 256 BETWEEN 64 AND 127""")
def _(t: Tables):
    ip = F.concat(F.lit("10."), F.col("user_id") % 4, F.lit(".7."), F.col("event_id") % 256)
    return P.where(t.events.select("event_id", ip.alias("ip")), C("ip", "ip_in_range", "10.1.7.64/26")).select("event_id")


register("udf_02_date_after_before",
         lambda t: P.where(t.orders, P.all_of(C("o_orderdate", "date_after", "1996-06-30"),
                                              C("o_orderdate", "date_before", "1997-01-01"))).select("o_orderkey"),
         "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30' AND o_orderdate < TIMESTAMP '1997-01-01'")

register("udf_02_jsonpath_exists",
         lambda t: P.where(t.events, P.all_of(C("props", "jsonpath_exists", "$.k"),
                                              C("value", "lte", 2))).select("event_id"),
         "SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND value <= 2")
