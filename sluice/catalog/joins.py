"""JON and SET: lookups, expansion, hierarchies, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.catalog.base import Tables, query, register
from sluice.operators import changes as H, expand as X
from sluice.sources import messages

register("jon_01_lookup",
         lambda t: X.lookup(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"], "nation", ["n_name"])
         .select("c_custkey", "n_name", "enriched_from"),
         "SELECT c_custkey, n_name, 'nation' AS enriched_from FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
register("jon_02_expand_for_each", lambda t: X.expand(t.orders, t.lineitem, {"o_orderkey": "l_orderkey"})
         .select("l_orderkey", "l_linenumber", "l_partkey"),
         "SELECT l_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
register("jon_02_expand_repeated_parent",
         lambda t: X.expand(t.orders, t.customer, {"o_custkey": "c_custkey"}).select("c_custkey", "c_name"),
         "SELECT c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
register("jon_02_expand_two_bindings",
         lambda t: X.expand(t.customer.select("c_nationkey", (F.col("c_custkey") % 5).alias("r")), t.nation,
                            {"c_nationkey": "n_nationkey", "r": "n_regionkey"}),
         "SELECT nation.* FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 5 = n_regionkey")
register("jon_03_expand_fallback",
         lambda t: X.expand(t.orders.filter("o_totalprice < 0"), t.lineitem, {"o_orderkey": "l_orderkey"}, stored_parent=t.orders)
         .select("l_orderkey", "l_linenumber", "l_partkey"),
         "SELECT l_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
register("jon_04_expand_none", lambda t: X.expand(t.orders, t.part, {}, mode="none").select("p_partkey", "p_name"),
         "SELECT p_partkey, p_name FROM part")


def _types(t: Tables):
    """Customers as a tree of types: the parent of ``n`` is ``n / 2``, number 0 has none."""
    parent = F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 2).cast("bigint"))
    return t.customer.select(F.col("c_custkey").alias("id"), parent.alias("parent_id"))


register("jon_05_hierarchy_depth", lambda t: X.hierarchy_depth(_types(t), "id", "parent_id").select("id", "depth"), """
    WITH RECURSIVE types AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS parent_id FROM customer),
         walk AS (SELECT id, parent_id AS up, 1 AS depth, [id] AS path FROM types
                  UNION ALL SELECT walk.id, types.parent_id, depth + 1, list_append(path, types.id)
                  FROM walk JOIN types ON walk.up = types.id WHERE NOT list_contains(path, types.id))
    SELECT id, max(depth) AS depth FROM walk GROUP BY id""")


def _large(t: Tables):
    return t.orders.filter("o_totalprice > 450000").withColumnRenamed("o_custkey", "c_custkey")


register("jon_06_entity_exists", lambda t: H.existing_entities(t.customer, _large(t), ["c_custkey"]).select("c_custkey", "c_name"),
         "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
register("jon_06_entity_missing", lambda t: H.missing_entities(t.customer, _large(t), ["c_custkey"]).select("c_custkey", "c_name"),
         "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")


@query("jon_07_unseen_events", """
    SELECT event_id, id FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE 'e' || (event_id // 2) END AS id FROM events)
    WHERE id = '' OR id NOT IN (SELECT 'e' || (event_id // 2) FROM events WHERE event_type IN ('click', 'view'))""")
def _(t: Tables):
    pair = F.concat(F.lit("e"), F.floor(F.col("event_id") / 2))
    rows = t.events.select("event_id", F.when(F.col("event_type") == "error", F.lit("")).otherwise(pair).alias("id"))
    done = t.events.filter(F.col("event_type").isin("click", "view")).select(pair.alias("id"))
    return H.unseen_events(rows, done, "id")


@query("set_01_union_sources", """
    SELECT event_id AS id, event_type AS kind, NULL::DOUBLE AS amount, 'events' AS source FROM events
    UNION ALL SELECT o_orderkey, NULL, o_totalprice, 'orders' FROM orders
    UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, NULL FROM customer""")
def _(t: Tables):
    return X.union_sources([
        t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit("events").alias("source")),
        t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.lit("orders").alias("source")),
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("amount")),
    ])


def _topic(t: Tables, topic: str, kind: str):
    body = F.to_json(F.struct("event_id", "event_type"))
    rows = t.events.filter(F.col("event_type") == kind)
    return rows.select(messages.kafka_rows(F.col("user_id").cast("string"), body, F.lit(topic), F.col("event_id") % 3, F.col("event_id"), F.col("ts")))


@query("set_02_several_topics", """
    SELECT event_type || 's' AS origin, event_id FROM events""")
def _(t: Tables):
    topics = X.union_sources([_topic(t, f"{kind}s", kind) for kind in ("click", "view", "error", "signup", "purchase")])
    return messages.record_fields(messages.decode_kafka(topics), "event_id bigint").select(F.col("_meta.origin").alias("origin"), "event_id")
