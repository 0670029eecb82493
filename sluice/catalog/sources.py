"""SRC: reading records; UDF-04.  Files are written from the tables first, into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.catalog.base import Tables, query, register
from sluice.session import scratch_path
from sluice.sources import api_pages, change_feed, demo, files, messages, registry, schema, tables
from sluice.streaming.dedup import batch_store
from sluice.streaming.polled import PolledTable
from sluice.streaming.run import run_to_table

EVENT = "event_id bigint, user_id bigint, event_type string, value double"
COLUMNS = ["event_id", "user_id", "event_type", "value"]
ALL_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def _events(t: Tables) -> DataFrame:
    return t.events.select(COLUMNS)


def _written(df: DataFrame, label: str, fmt: str = "json", **options) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("src_01_json_array", ALL_EVENTS)
def _(t: Tables):
    """Files of one array with 5,000 objects each."""
    path = scratch_path(t.spark, "array")
    items = F.array_join(F.collect_list(F.to_json(F.struct(*COLUMNS))), ",")
    chunks = _events(t).groupBy(F.floor(F.col("event_id") / 5000).alias("chunk"))
    chunks.agg(F.concat(F.lit("["), items, F.lit("]")).alias("value")).write.partitionBy("chunk").text(path)
    return files.read_json_array(t.spark, path, EVENT).drop("chunk")


def _lines_with_errors(t: Tables) -> str:
    good = F.to_json(F.struct(*COLUMNS))
    broken = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(good)
    return _written(t.events.select(broken.alias("value")), "ndjson", "text")


register("src_01_ndjson", lambda t: files.read_ndjson(t.spark, _lines_with_errors(t), EVENT), ALL_EVENTS + " WHERE event_type <> 'error'")
register("src_01_ndjson_schemaless",
         lambda t: messages.record_fields(files.read_json_records(t.spark, _lines_with_errors(t)), EVENT),
         ALL_EVENTS + " WHERE event_type <> 'error'")
register("src_02_csv",
         lambda t: files.read_csv(t.spark, _written(t.customer, "csv", "csv", header=True)),
         "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
         "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer")


def _ordered_lines(t: Tables) -> str:
    """Files of 3,000 numbered lines each."""
    path = scratch_path(t.spark, "lines")
    line = F.struct("event_id", F.concat_ws(" ", "event_id", "event_type").alias("line"))
    chunks = t.events.groupBy(F.floor(F.col("event_id") / 3000).alias("part"))
    text = F.array_join(F.array_sort(F.collect_list(line))["line"], "\n")
    chunks.agg(text.alias("value")).write.partitionBy("part").text(path)
    return path


register("src_03_lines",
         lambda t: files.read_lines(t.spark, _ordered_lines(t)).select("line", "line_no"),
         "SELECT event_id || ' ' || event_type AS line, row_number() OVER (PARTITION BY event_id // 3000 ORDER BY event_id) AS line_no FROM events")


@query("src_04_multi_path_glob", ALL_EVENTS)
def _(t: Tables):
    path = scratch_path(t.spark, "many")
    _events(t).withColumn("kind", F.col("event_type")).write.partitionBy("kind").json(path)
    return files.read_files(t.spark, "json", [f"{path}/kind=view", f"{path}/kind=[ce]*", f"{path}/kind=[ps]*"], ).select(COLUMNS)


register("src_05_parquet", lambda t: files.read_parquet(t.spark, t.path("customer")), "SELECT * FROM customer")
register("src_05_delimiter",
         lambda t: files.read_csv(t.spark, _written(t.nation, "tsv", "csv", header=True, sep=";"), ";").select("n_nationkey", "n_name"),
         "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
register("src_06_sql_bytes_as_text",
         lambda t: tables.decode_bytes(t.customer.select("c_custkey", F.encode("c_name", "UTF-8").alias("c_name"))),
         "SELECT c_custkey, c_name FROM customer")


@query("src_07_incremental", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders)")
def _(t: Tables):
    marks = tables.MarkStore(t.spark, scratch_path(t.spark, "marks"))
    middle = F.floor(F.max("o_orderkey") / 2).cast("bigint")
    marks.put("orders", t.orders.agg(middle).first()[0])
    return tables.incremental(t.orders, "o_orderkey", int(marks.get("orders"))).select("o_orderkey", "o_custkey")


@query("src_08_poll_drained", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type <> 'view'")
def _(t: Tables):
    """Every page of the table, each in an order other than the id's."""
    out, marks = scratch_path(t.spark, "polled"), tables.MarkStore(t.spark, scratch_path(t.spark, "marks"))
    for _mark in tables.poll_all(t.events, lambda df: df.write.mode("append").parquet(out), marks, "events", 500, id_column="event_id",
                                 columns=["event_type"], condition=".event_type != 'view'", order_by="event_type", batch_size=2500):
        pass
    return t.spark.read.parquet(out).select("event_id", "event_type")


@query("src_08_poll_stream", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type <> 'view'")
def _(t: Tables):
    """The table polled by a stream that is stopped after two pages and goes on from its checkpoint."""
    out, state, checkpoint = (scratch_path(t.spark, n) for n in ("polled", "last-ids", "poll-state"))
    polled = lambda: PolledTable(t.spark, state, lambda: t.events, "event_id", ["event_type"], ".event_type != 'view'", "event_type", 2500, 500)
    write = batch_store(t.spark, out)
    polled().drain(write, checkpoint, most=2)
    polled().drain(write, checkpoint)
    return t.spark.read.parquet(out).select("event_id", "event_type")


@query("src_08_event_source", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type <> 'view'")
def _(t: Tables):
    return registry.load(t.spark, {"type": "sql_event", "table": {"type": "parquet", "path": t.path("events")}, "last": 500,
                                   "options": {"id_column": "event_id", "columns": ["event_type"], "condition": ".event_type != 'view'"}}
                         ).select("event_id", "event_type")


@query("src_01_json_auto", "SELECT event_id, event_type, event_type || ' ' || user_id AS label FROM events")
def _(t: Tables):
    """Array files of at most 500 objects and files of lines in one folder, with lines that are not records."""
    path = scratch_path(t.spark, "mixed")
    label = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    record = F.to_json(F.struct("event_id", "event_type", label.alias("label")))
    odd = F.col("event_id") % 2 == 1
    lines = t.events.filter(odd).select(F.concat(F.lit("\t"), record).alias("value"))
    wrong = t.events.select(F.explode(F.array(F.lit('"x"'), F.lit('{"event_id": 1} x'), F.lit("{broken"), F.lit("7"))).alias("value"))
    lines.unionByName(wrong).write.text(f"{path}/lines")
    arrays = t.events.filter(~odd).groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.concat_ws(",\n", F.collect_list(record)).alias("items"))
    arrays.select(F.concat(F.lit("\n[ "), "items", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/arrays")
    out = registry.load(t.spark, {"type": "file", "format": "json", "path": [f"{path}/lines", f"{path}/arrays"],
                                  "schema": "event_id bigint, event_type string, label string"})
    return out


@query("src_09_repeated_headers", "SELECT event_id, 'b' || event_id AS trace FROM events")
def _(t: Tables):
    header = lambda mark: F.struct(F.lit("trace").alias("key"), F.encode(F.concat(F.lit(mark), F.col("event_id")), "UTF-8").alias("value"))
    rows = t.events.select(messages.kafka_rows(F.col("user_id").cast("string"), F.to_json(F.struct("event_id")), F.lit("e"), F.lit(0), F.col("event_id"),
                                               F.col("ts"), F.array(header("a"), header("b"))))
    return messages.record_fields(messages.decode_kafka(rows), "event_id bigint").select("event_id", F.col("_headers")["trace"].alias("trace"))


register("src_08_event_table_poll",
         lambda t: tables.poll(t.events, 500, "event_id", ["event_id", "event_type"], ".event_type != 'view'", batch_size=1000),
         "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type <> 'view' ORDER BY event_id LIMIT 1000")


def _kafka(t: Tables) -> DataFrame:
    body = F.when(F.col("event_type") == "error", F.lit("plain")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    key = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("user_id").cast("string"))
    header = F.struct(F.lit("trace").alias("key"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value"))
    headers = F.when(F.col("user_id") % 2 == 0, F.array(header)).otherwise(F.array().cast("array<struct<key:string,value:binary>>"))
    return t.events.select(messages.kafka_rows(key, body, F.lit("events"), F.col("event_id") % 4, F.col("event_id"), F.col("ts"), headers))


@query("src_09_kafka_decode", """
    SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id, CASE WHEN event_type = 'error' THEN 'plain' END AS value,
           CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) END AS key,
           CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS _key,
           CASE WHEN user_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS trace,
           'events' AS origin, (event_id % 4) || ':' || event_id AS "offset", epoch_us(ts) // 1000 AS timestamp FROM events""")
def _(t: Tables):
    out = messages.record_fields(messages.decode_kafka(_kafka(t)), "event_id bigint, value string, key string")
    return out.select("event_id", "value", "key", "_key", F.col("_headers")["trace"].alias("trace"),
                      "_meta.origin", "_meta.offset", "_meta.timestamp")


def _feed(t: Tables) -> DataFrame:
    """Orders as a change feed: status O updates, P deletes, F inserts."""
    op = F.when(F.col("o_orderstatus") == "P", "d").when(F.col("o_orderstatus") == "O", "u").otherwise("c")
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    old = F.struct(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") - 1).alias("amount"))
    return t.orders.select(op.alias("op"), F.lit("shop").alias("db"), F.lit("orders").alias("tbl"), F.col("o_orderdate").alias("ts"),
                           old.alias("before"), row.alias("after"))


@query("src_11_cdc_flatten", """
    SELECT CASE o_orderstatus WHEN 'P' THEN 'DELETE' WHEN 'O' THEN 'UPDATE' ELSE 'INSERT' END AS _cdc_type, 'shop' AS _database,
           'orders' AS _table, epoch_us(o_orderdate) // 1000 AS _timestamp, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS id,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount,
           CASE WHEN o_orderstatus IN ('P', 'O') THEN o_totalprice - 1 END AS old_amount,
           CAST(o_orderkey AS VARCHAR) AS primary_key, 'shop.orders' AS origin FROM orders""")
def _(t: Tables):
    out = change_feed.flatten(_feed(t), ["id"])
    return out.select("_cdc_type", "_database", "_table", "_timestamp", "id", "amount", F.col("_old_data.amount").alias("old_amount"),
                      F.col("_primary_key")[0].alias("primary_key"), "_meta.origin")


register("src_12_cdc_pairs",
         lambda t: change_feed.paired(_feed(t)).select("op", F.col("before.id").alias("old_id"), F.col("after.id").alias("new_id")),
         "SELECT CASE o_orderstatus WHEN 'P' THEN 'd' WHEN 'O' THEN 'u' ELSE 'c' END AS op, "
         "CASE WHEN o_orderstatus IN ('P', 'O') THEN o_orderkey END AS old_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS new_id FROM orders")


def _responses(t: Tables) -> DataFrame:
    """One landed response per web page: items in ``data`` or ``rows``, or an object of its own."""
    item = lambda n: F.struct(F.lit("item").alias("kind"), (F.col("page_id") * 10 + n).alias("id"))
    kind = F.col("page_id") % 3
    body = (F.when(kind == 0, F.to_json(F.struct(F.array(item(1), item(2)).alias("data"))))
            .when(kind == 1, F.to_json(F.struct(F.array(item(1)).alias("rows"), F.lit("page").alias("kind"), F.col("page_id").alias("id"))))
            .otherwise(F.to_json(F.struct(F.lit("single").alias("kind"), F.col("page_id").alias("id")))))
    return t.pages.select(F.concat(F.lit("u"), "page_id").alias("url"), F.lit(1).alias("page_no"), "page_id", body.alias("body"))


ITEM = "kind string, id bigint"
register("src_13_unnest_unpaginated", lambda t: messages.record_fields(api_pages.unnest(_responses(t), keep=["url"]), ITEM),
         """SELECT 'u' || page_id AS url, 'item' AS kind, page_id * 10 + n AS id FROM pages, (VALUES (1), (2)) AS v(n) WHERE page_id % 3 = 0
            UNION ALL SELECT 'u' || page_id, CASE page_id % 3 WHEN 1 THEN 'page' ELSE 'single' END, page_id FROM pages WHERE page_id % 3 <> 0""")
register("src_13_unnest_data_field",
         lambda t: messages.record_fields(api_pages.unnest(_responses(t), "rows", paginated=True, keep=["url"]), ITEM),
         "SELECT 'u' || page_id AS url, 'item' AS kind, page_id * 10 + 1 AS id FROM pages WHERE page_id % 3 = 1")
register("src_13_unnest_whole_body",
         lambda t: messages.record_fields(api_pages.unnest(_responses(t), paginated=True, keep=["url"]), ITEM),
         "SELECT 'u' || page_id AS url, CASE page_id % 3 WHEN 1 THEN 'page' WHEN 2 THEN 'single' END AS kind, "
         "CASE WHEN page_id % 3 <> 0 THEN page_id END AS id FROM pages")


def _chained(t: Tables) -> DataFrame:
    """Pages linked to the page seven further on, ten to a chain; the last has an empty link."""
    following = F.when(F.col("page_id") % 70 < 63, F.concat(F.lit("u"), F.col("page_id") + 7)).otherwise(F.lit(""))
    return t.pages.select(F.concat(F.lit("u"), "page_id").alias("url"), "page_id", F.to_json(F.struct(following.alias("next"))).alias("body"))


def _chain_sql(cap: int) -> str:
    return f"""WITH RECURSIVE walk AS (SELECT 'u' || page_id AS start, page_id, 1 AS page_no FROM pages WHERE page_id % 70 < 7
        UNION ALL SELECT start, p.page_id, page_no + 1 FROM walk JOIN pages p ON p.page_id = walk.page_id + 7
                  WHERE walk.page_id % 70 < 63 AND page_no < {cap})
        SELECT start, 'u' || page_id AS url, page_no FROM walk"""


def _follow(cap: int):
    def build(t: Tables) -> DataFrame:
        pages = _chained(t)
        return api_pages.follow_next(pages, pages.filter("page_id % 70 < 7").select("url"), max_pages=cap)

    return build


register("src_14_next_url_chain", _follow(100), _chain_sql(100))
register("src_14_next_url_cap", _follow(6), _chain_sql(6))


def _numbered(t: Tables) -> DataFrame:
    """Ten numbered pages to a chain; some are empty, some lack an offset or are not full."""
    n = F.col("page_id")
    data = F.when(n % 7 == 6, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    body = F.to_json(F.struct(data.alias("data"), F.when(n % 9 != 8, n).alias("next_offset"),
                              F.when(n % 8 == 7, 3).otherwise(5).alias("count"), F.lit(5).alias("per_page")))
    return t.pages.select("page_id", F.floor(n / 10).alias("chain"), (n % 10 + 1).alias("page_no"), body.alias("body"))


def _stop_sql(stop: str, compare: str) -> str:
    return f"""SELECT page_id, page_no FROM (SELECT page_id, page_id % 10 + 1 AS page_no,
        min(CASE WHEN {stop} THEN page_id % 10 + 1 END) OVER (PARTITION BY page_id // 10) AS last FROM pages)
        WHERE last IS NULL OR page_no {compare} last"""


for _kind, _stop, _compare in [("page_increment", "page_id % 7 = 6", "<"), ("next_offset", "page_id % 9 = 8", "<="),
                               ("page_with_count", "page_id % 8 = 7", "<=")]:
    register(f"src_15_{_kind}", lambda t, kind=_kind: api_pages.stop_pages(_numbered(t), kind).select("page_id", "page_no"),
             _stop_sql(_stop, _compare))


@query("src_16_partitioned_source", ALL_EVENTS + " WHERE event_type <> 'signup'")
def _(t: Tables):
    path = scratch_path(t.spark, "parts")
    _events(t).withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(path)
    parts = [{"enabled": k != "signup", "config": {"path": f"{path}/kind={k}"}} for k in ("click", "view", "error", "signup", "purchase")]
    return registry.load_partitioned(t.spark, {"type": "file", "format": "parquet"}, parts)


@query("src_17_demo_events", """
    SELECT event_id AS id, 'Demo event ' || event_id AS message, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
           ['debug', 'info', 'warn', 'error'][event_id % 4 + 1] AS level, 'demo' AS source FROM events""")
def _(t: Tables):
    return demo.demo_events(t.events, "event_id", ts=F.col("ts").cast("timestamp"))


@query("src_18_generated_logs", "SELECT count(*) AS n, count(*) AS ok FROM events")
def _(t: Tables):
    logs = demo.sample_logs(t.events.select(F.col("event_id").alias("id")))
    fine = (F.col("id").rlike("^[0-9a-f-]{36}$") & F.col("level").isin(demo.LOG_LEVELS) & F.col("service").isin(demo.SERVICES)
            & F.col("latency_ms").between(0, 999) & F.col("user_id").rlike(r"^user_\d{1,2}$"))
    return logs.agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("ok"))


@query("src_19_metadata", """
    SELECT event_id, 'file' AS source, 'events.parquet' AS origin, epoch_us(ts) // 1000 AS timestamp FROM events""")
def _(t: Tables):
    origin = F.regexp_extract(F.col("_metadata.file_path"), r"(events\.parquet)", 1)
    rows = t.events.select("event_id", "ts", origin.alias("origin"))
    out = files.with_metadata(rows, "file", F.col("origin"), None, F.col("ts"))
    return out.select("event_id", "_meta.source", "_meta.origin", "_meta.timestamp")


@query("src_21_multiline_entries", """
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
         marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY n) AS entry FROM lines)
    SELECT doc_id, min(n) AS line_no, string_agg(line, chr(10) ORDER BY n) AS entry FROM marked GROUP BY doc_id, marked.entry""")
def _(t: Tables):
    lines = t.documents.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    numbered = lines.select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    return files.group_lines(numbered, "^[A-M]").select(F.col("file").cast("bigint").alias("doc_id"), "line_no", "entry")


@query("src_22_file_tail", ALL_EVENTS)
def _(t: Tables):
    path = scratch_path(t.spark, "tail")
    _events(t).write.json(path)
    t.events.select(F.lit(-1).cast("bigint").alias("event_id")).write.mode("append").option("compression", "gzip").json(path)
    return run_to_table(files.stream_files(t.spark, "json", path, EVENT, include="*.json*", exclude="*.gz"), "tailed")


FIELDS = [{"name": "event_id", "type": "int", "required": True}, {"name": "event_type", "type": "string"},
          {"name": "value", "type": "float"}, {"name": "ts", "type": "datetime"}]


@query("src_23_field_schema", "SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events")
def _(t: Tables):
    path = _written(t.events.withColumn("ts", F.col("ts").cast("timestamp")).drop("props"), "typed",
                    timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    out = schema.reader(t.spark, FIELDS).json(path)
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


EVENT_RECORD = """{"type": "record", "name": "Event", "namespace": "demo", "fields": [
    {"name": "event_id", "type": "long"},
    {"name": "event_type", "type": {"type": "enum", "name": "Kind", "symbols": ["click", "view", "error", "purchase", "signup"]}},
    {"name": "value", "type": ["null", "float", "double"], "default": null},
    {"name": "ts", "type": {"type": "long", "logicalType": "local-timestamp-micros"}},
    {"name": "tags", "type": {"type": "array", "items": ["null", "string"]}},
    {"name": "actor", "type": {"type": "record", "name": "Actor", "fields": [{"name": "user_id", "type": ["int", "long"]}, {"name": "last", "type": "Kind"}]}}]}"""


@query("src_23_avro_schema", """
    SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type || ',' || event_id AS tags, user_id, event_type AS last FROM events""")
def _(t: Tables):
    """JSON files read with the schema that an Avro record definition names."""
    moment = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    rows = t.events.select("event_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"),
                           F.array("event_type", F.col("event_id").cast("string")).alias("tags"), F.struct("user_id", F.col("event_type").alias("last")).alias("actor"))
    path = _written(rows, "avro", timestampNTZFormat=moment)
    out = schema.reader(t.spark, schema.source_schema("avro", EVENT_RECORD)).option("timestampNTZFormat", moment).json(path)
    return out.select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                      F.array_join("tags", ",").alias("tags"), "actor.user_id", "actor.last")


@query("src_23_infer_json", "SELECT 'OBJECT<k: BIGINT>' AS inferred FROM (SELECT count(*) AS n FROM events) WHERE n > 0")
def _(t: Tables):
    found = F.schema_of_variant_agg(F.try_parse_json("props"))
    return t.events.agg(found.alias("inferred"))


@query("src_24_message_unwrap", """
    SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id, CASE WHEN event_type = 'error' THEN 'plain' END AS message,
           event_id % 4 AS _meta_shard FROM events""")
def _(t: Tables):
    body = F.when(F.col("event_type") == "error", F.lit("plain")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    rows = t.events.select(body.alias("body"), F.date_format("ts", "HH:mm").alias("at"), (F.col("event_id") % 4).alias("shard"))
    return messages.record_fields(messages.unwrap_message(rows, "body", "at", ["shard"]), "event_id bigint, message string")


# -- a source written in Python ----------------------------------------------------------

class _Group(InputPartition):
    def __init__(self, path: str, group: int):
        super().__init__(None)
        self.path, self.group = path, group


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self):
        import glob
        import os

        import pyarrow.parquet as pq

        found = sorted(glob.glob(f"{self.path}/*.parquet")) if os.path.isdir(self.path) else [self.path]
        return [_Group(p, g) for p in found for g in range(pq.ParquetFile(p).num_row_groups)]

    def read(self, partition):
        import pyarrow.parquet as pq

        yield from pq.ParquetFile(partition.path).read_row_group(partition.group, columns=self.columns).to_batches()


class RowGroups(DataSource):
    """Example of a custom source: one partition per parquet row group, as Arrow batches."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return RowGroupReader(self.options["path"], schema.names)


@query("udf_04_custom_source", "SELECT event_id, event_type FROM events")
def _(t: Tables):
    registry.register_data_source(t.spark, RowGroups)
    return registry.load(t.spark, {"type": "row_groups", "path": t.path("events"), "schema": "event_id bigint, event_type string"})


@query("udf_04_custom_loader", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables):
    registry.register_source("region_table", lambda spark, cfg: spark.read.parquet(cfg["where"]))
    return registry.load(t.spark, {"type": "region_table", "where": t.path("region")})
