"""VAL: validation; SET-03."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query, register
from sluice.operators import expand as X, validate as V


def _listed(df, schema, key: str, variant: str | None = None):
    """Key and error text of every row."""
    return V.check(df, schema, variant).select(key, V.error_text().alias("errors"))


def _gaps(t: Tables):
    return t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"), "value")


KIND = {"fields": [{"name": "kind", "type": "string", "required": True, "max_length": 6}]}
register("val_01_validate_drop", lambda t: V.validate(_gaps(t), KIND).select("event_id", "kind"),
         "SELECT event_id, event_type AS kind FROM events WHERE event_type <> 'error' AND strlen(event_type) <= 6")
register("val_01_quarantine",
         lambda t: V.quarantine(V.check(_gaps(t), KIND)).select("event_id", V.error_text().alias("errors")),
         "SELECT event_id, CASE event_type WHEN 'error' THEN 'kind: required field is missing' "
         "ELSE 'kind: must have at most 6 bytes' END AS errors FROM events "
         "WHERE event_type = 'error' OR strlen(event_type) > 6")


def _records(t: Tables):
    """Schemaless records: ``k`` absent, null, text or number; an array and an object."""
    text = (
        F.when(F.col("event_type") == "view", F.lit("{}"))
        .when(F.col("event_type") == "click", F.lit('{"k": null, "extra": 1}'))
        .when(F.col("event_type") == "signup", F.lit('{"k": "text", "tags": ["a", 5, "b"]}'))
        .when(F.col("event_type") == "error", F.lit('{"k": 1.5, "address": {"city": "Oslo"}}'))
        .otherwise(F.lit('{"k": 7, "tags": ["a", "b"], "address": {"city": "Oslo", "zip": "0150"}}'))
    )
    return t.events.select("event_id", F.parse_json(text).alias("rec"))


def _by_type(errors: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in errors.items())
    return f"SELECT event_id, CASE event_type {cases} ELSE '' END AS errors FROM events" if cases \
        else "SELECT event_id, '' AS errors FROM events"


def _variant_check(name: str, schema: dict, errors: dict[str, str]) -> None:
    register(name, lambda t: _listed(_records(t), schema, "event_id", "rec"), _by_type(errors))


_variant_check("val_02_required", {"fields": [{"name": "k", "type": "any", "required": True}]},
               {"view": "k: required field is missing", "click": "k: null is not allowed"})
_variant_check("val_03_type_integer", {"fields": [{"name": "k", "type": "integer"}]},
               {"signup": "k: must be an integer", "error": "k: must be an integer"})
_variant_check("val_03_type_number", {"fields": [{"name": "k", "type": "number"}]}, {"signup": "k: must be a number"})
_variant_check("val_03_type_string", {"fields": [{"name": "k", "type": "string"}]},
               {"error": "k: must be a string", "purchase": "k: must be a string"})
_variant_check("val_08_array_items", {"fields": [{"name": "tags", "type": "array", "items": {"type": "string"}}]},
               {"signup": "tags: item [1]: must be a string"})
_variant_check("val_09_object_properties",
               {"fields": [{"name": "address", "type": "object", "properties": [
                   {"name": "city", "type": "string", "required": True}, {"name": "zip", "type": "string", "required": True}]}]},
               {"error": "address: property zip is missing"})
_variant_check("val_11_strict", {"fields": [{"name": "k"}, {"name": "tags"}], "strict": True},
               {"click": "extra: field is not defined in the schema",
                "error": "address: field is not defined in the schema",
                "purchase": "address: field is not defined in the schema"})

register("val_04_byte_length",
         lambda t: _listed(t.documents, {"fields": [{"name": "text", "type": "string", "min_length": 200, "max_length": 2000}]}, "doc_id"),
         "SELECT doc_id, CASE WHEN strlen(text) < 200 THEN 'text: must have at least 200 bytes' "
         "WHEN strlen(text) > 2000 THEN 'text: must have at most 2000 bytes' ELSE '' END AS errors FROM documents")
register("val_05_pattern",
         lambda t: _listed(t.part, {"fields": [{"name": "p_name", "type": "string", "pattern": "^(red|blue) "}]}, "p_partkey"),
         "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue) ') THEN '' "
         "ELSE 'p_name: must match ^(red|blue) ' END AS errors FROM part")
register("val_06_range",
         lambda t: _listed(t.customer, {"fields": [{"name": "c_acctbal", "type": "number", "min": 0, "max": 9000}]}, "c_custkey"),
         "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'c_acctbal: must be at least 0' "
         "WHEN c_acctbal > 9000 THEN 'c_acctbal: must be at most 9000' ELSE '' END AS errors FROM customer")
register("val_07_enum",
         lambda t: _listed(t.orders, {"fields": [{"name": "o_orderstatus", "type": "string", "enum": ["F", "O"]}]}, "o_orderkey"),
         "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN '' ELSE 'o_orderstatus: must be one of F, O' END AS errors "
         "FROM orders")
register("val_08_array_items_typed",
         lambda t: _listed(t.embeddings, {"fields": [{"name": "embedding", "type": "array", "items": {"type": "number", "min": -0.2}}]}, "vec_id"),
         "SELECT vec_id, CASE WHEN first_bad IS NULL THEN '' ELSE 'embedding: item [' || (first_bad - 1) || ']: must be at least -0.2' END AS errors "
         "FROM (SELECT vec_id, list_position(list_transform(embedding, lambda x: CAST(x AS DOUBLE) < CAST(-0.2 AS DOUBLE)), true) AS first_bad FROM embeddings)")


def _users(t: Tables):
    user = F.struct(F.nullif("event_type", F.lit("error")).alias("name"), F.col("value").alias("age"))
    return t.events.select("event_id", user.alias("user"))


register("val_10_nested_names",
         lambda t: _listed(_users(t), {"fields": [{"name": "user.name", "type": "string", "required": True},
                                                  {"name": "user.age", "type": "number", "max": 20}]}, "event_id"),
         "SELECT event_id, concat_ws('; ', CASE WHEN event_type = 'error' THEN 'user.name: required field is missing' END, "
         "CASE WHEN value > 20 THEN 'user.age: must be at most 20' END) AS errors FROM events")
register("val_12_all_errors",
         lambda t: _listed(t.customer, {"fields": [
             {"name": "c_acctbal", "type": "number", "min": 0},
             {"name": "c_mktsegment", "type": "string", "enum": ["BUILDING", "MACHINERY"]},
             {"name": "absent", "type": "string", "required": True}]}, "c_custkey"),
         "SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'c_acctbal: must be at least 0' END, "
         "CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment: must be one of BUILDING, MACHINERY' END, "
         "'absent: required field is missing') AS errors FROM customer")


@query("val_13_single_field", """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'required field is missing' WHEN 'purchase' THEN 'must have at most 6 bytes' END AS error,
           'field other is not defined in the schema' AS unknown FROM events""")
def _(t: Tables):
    rows = _gaps(t)
    return rows.select("event_id", V.single_field_error(rows, KIND, "kind").alias("error"),
                       V.single_field_error(rows, KIND, "other").alias("unknown"))


CONFIG = {"strict": True, "fields": [
    {"name": "o_orderkey", "type": "integer", "required": True, "min": 0},
    {"name": "o_orderpriority", "type": "string", "pattern": "^[1-5]-"},
    {"name": "o_totalprice", "type": "number", "max": 400000.5},
]}
register("val_14_schema_from_config",
         lambda t: _listed(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey"), CONFIG, "o_orderkey"),
         "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice > 400000.5 THEN 'o_totalprice: must be at most 400000.5' END, "
         "'o_custkey: field is not defined in the schema') AS errors FROM orders")
register("val_15_valid_counts", lambda t: V.valid_counts(V.check(_gaps(t), KIND)),
         "SELECT count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid "
         "FROM (SELECT event_type <> 'error' AND strlen(event_type) <= 6 AS ok FROM events)")

JSON_SCHEMA = {"type": "object", "required": ["kind", "note"],
               "properties": {"kind": {"type": "string", "enum": ["click", "view"]}, "value": {"type": "number", "maximum": 10}}}
register("val_16_json_schema", lambda t: _listed(_gaps(t), V.schema_from_json_schema(JSON_SCHEMA), "event_id"),
         "SELECT event_id, concat_ws('; ', CASE WHEN event_type = 'error' THEN 'kind: required field is missing' "
         "WHEN event_type NOT IN ('click', 'view') THEN 'kind: must be one of click, view' END, "
         "CASE WHEN value > 10 THEN 'value: must be at most 10' END, 'note: required field is missing') AS errors FROM events")


@query("set_03_undefined_fields", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'extra' WHEN 'error' THEN 'address' WHEN 'purchase' THEN 'address' ELSE '' END AS extra
    FROM events""")
def _(t: Tables):
    return _records(t).select("event_id", F.array_join(X.undefined_keys(F.col("rec"), ["k", "tags"]), ",").alias("extra"))
