import pytest
from pyspark.sql import functions as F

from sluice.operators import changes as H, expand as X, statistics
from sluice.plans import dataflow
from sluice.session import scratch_path
from sluice.sinks import render, writers as W
from sluice.sources import api_pages, files, messages, registry, schema, tables


def test_kafka_options():
    got = messages.kafka_options(["a:9092", "b:9092"], ["t1", "t2"], "g", "earliest", 500, max_wait="1 minute")
    assert got == {"kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "t1,t2", "startingOffsets": "earliest",
                   "groupIdPrefix": "g", "maxOffsetsPerTrigger": "500", "maxTriggerDelay": "1 minute"}
    with pytest.raises(ValueError):
        messages.kafka_options(["a"], ["t"], start="middle")


def test_array_files_of_the_mixed_folder_do_not_grow_with_the_table(spark, monkeypatch):
    from sluice.catalog import QUERIES

    paths, load = [], registry.load
    monkeypatch.setattr(registry, "load", lambda session, spec: paths.append(spec["path"][1]) or load(session, spec))
    assert QUERIES["src_01_json_auto"](spark, "/root/testdata/sf0.01").distinct().count() == 10_000
    objects = [r.value.count('"event_id"') for r in spark.read.text(paths[0], wholetext=True).collect()]
    assert objects == [500] * 10


def test_lag():
    progress = {"sources": [{"endOffset": {"t": {"0": 5, "1": 10}}, "latestOffset": {"t": {"0": 8, "1": 10}}},
                            {"endOffset": '{"u": {"0": 1}}', "latestOffset": '{"u": {"0": 3}}'}]}
    assert messages.lag(progress) == 5


def test_rate_limits():
    assert messages.rate_limit_options(100, "minute", 20) == {"maxOffsetsPerTrigger": "120", "processingTime": "60 seconds"}
    assert messages.rate_limit_options(120, "minute", source="rate") == {"rowsPerSecond": "2"}


def test_jdbc_options():
    got = tables.jdbc_options("jdbc:x://h/db", "SELECT 1", "drv", "me", "pw")
    assert got["query"] == "SELECT 1" and got["driver"] == "drv" and "dsn" not in got
    assert tables.split_read_options("id", 0, 9, 4)["numPartitions"] == "4"


def test_line_numbers_over_many_splits(spark):
    path = scratch_path(spark, "lines")
    spark.range(5000).select(F.concat(F.lit("line "), "id").alias("value")).coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = files.read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5
        assert lines.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no") - 1)).count() == 0
        assert lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_path_is_an_error(spark):
    with pytest.raises(Exception):
        files.read_files(spark, "json", ["/tmp/sluice-no-such-path"]).count()


def test_malformed_array_is_an_error(spark):
    path = scratch_path(spark, "bad")
    spark.createDataFrame([('[{"a": 1}, {"a": ',)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        files.read_json_array(spark, path, "a bigint").collect()


def test_poll_until_empty_and_restart(spark):
    table = spark.range(1, 26).withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    marks = tables.MarkStore(spark, scratch_path(spark, "marks"))
    out = scratch_path(spark, "polled")
    save = lambda df: df.write.mode("append").parquet(out)
    assert list(tables.poll_all(table.filter("id <= 10"), save, marks, "t", batch_size=4)) == [4, 8, 10]
    assert list(tables.poll_all(table, save, marks, "t", batch_size=10)) == [20, 25]
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(1, 26))
    assert tables.poll(table, 3, condition=".kind == 'even'", columns=["id"], batch_size=2).collect()[1]["id"] == 6
    pages = [r["id"] for p in (3, 5, 7) for r in tables.poll(table, p, order_by="kind", batch_size=2).collect()]
    assert sorted(pages) == sorted(r["id"] for r in table.filter("id > 3 AND id <= 9").collect())


def _brute_pages(ids, last, size):
    """(end, sorted ids) of all pages; rows with the same id stay together."""
    left = sorted(i for i in ids if i is not None and i > last)
    while left:
        end = left[min(size, len(left)) - 1]
        yield end, [i for i in left if i <= end]
        left = [i for i in left if i > end]


@pytest.mark.parametrize("ahead, most", [(1024, 1 << 22), (3, 1 << 22), (3, 20)])
def test_pages_are_cut_and_stored_many_at_a_time(spark, monkeypatch, ahead, most):
    """Any order of ids, repeated and NULL ones, one id with more rows than a page or a task takes; a job or two for each page."""
    monkeypatch.setattr(tables, "PAGES_AHEAD", ahead)
    monkeypatch.setattr(tables, "ROWS_AHEAD", most)
    ids = [(i * 7919) % 1000 for i in range(120)] + [i * 3 for i in range(0, 200, 9)] + [500] * 25 + [None] * 12 + [10**15]
    path, marks = scratch_path(spark, "a table"), tables.MarkStore(spark, scratch_path(spark, "marks"))
    spark.createDataFrame([(i, f"k{n % 3}", n) for n, i in enumerate(ids)], "id bigint, kind string, n int").write.parquet(path)
    pages, group = [], f"poll-{ahead}-{most}"
    spark.sparkContext.setJobGroup(group, group)
    table = spark.read.parquet(path)
    got = list(tables.poll_all(table, lambda df: pages.append((df.columns, df.collect())), marks, "t", 17, columns=["n"], order_by="kind", batch_size=13))
    spark.sparkContext.setJobGroup("", "")
    wanted = list(_brute_pages(ids, 17, 13))
    assert got == [end for end, _ in wanted] and [sorted(r["id"] for r in rows) for _, rows in pages] == [w for _, w in wanted]
    for columns, rows in pages:
        assert columns == ["n", "id"] and [(r["n"] % 3, r["id"]) for r in rows] == sorted((r["n"] % 3, r["id"]) for r in rows)
    assert marks.get("t") == str(10**15)
    if ahead > len(pages):
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 2 * len(pages) + 16


def test_pages_follow_a_table_that_grows(spark):
    """Rows that come between those that were read ahead are part of the next page; rows behind them follow."""
    path = scratch_path(spark, "table")
    put = lambda ids: spark.createDataFrame([(i,) for i in ids], "id bigint").coalesce(1).write.mode("append").parquet(path)
    put(range(0, 100, 2))
    pages, last, got = tables.Pages(size=10), -1, []
    for more in ([], [98, 200], [51, 53], [], []):
        if more:
            put(more)
        last, rows = pages.next(spark.read.parquet(path), last)
        got.append([r["id"] for r in rows.collect()])
    assert got[:2] == [[*range(0, 20, 2)], [*range(20, 40, 2)]]
    assert got[2:] == [[40, 42, 44, 46, 48, 50, 51, 52, 53, 54], [*range(56, 76, 2)], [*range(76, 96, 2)]]
    assert sorted(r["id"] for r in pages.next(spark.read.parquet(path), last)[1].collect()) == [96, 98, 98, 200]
    assert pages.next(spark.read.parquet(path), 200) is None


def test_high_water_mark(spark):
    assert tables.high_water_mark(spark.range(5), "id") == 4
    assert tables.high_water_mark(spark.range(0), "id", 7) == 7
    assert tables.incremental(spark.range(5), "id", 2).count() == 2


def test_partitioned_source_skips_disabled(spark):
    registry.register_source("numbers", lambda s, cfg: s.range(cfg["n"]))
    parts = [{"config": {"n": 2}}, {"enabled": False, "config": {"n": 50}}, {"config": {"n": 3}}]
    assert registry.load_partitioned(spark, {"type": "numbers"}, parts).count() == 5
    assert registry.load(spark, {"type": "demo", "count": 3}).count() == 3


def test_cyclic_chain_stops_at_the_cap(spark):
    pages = spark.createDataFrame([("a", '{"next": "b"}'), ("b", '{"next": "a"}'), ("c", '{"next": "gone"}')], "url string, body string")
    got = api_pages.follow_next(pages, pages.filter("url <> 'b'").select("url"), max_pages=7)
    assert sorted((r["start"], r["page_no"], r["url"]) for r in got.collect()) == \
        [("a", i, "ab"[(i - 1) % 2]) for i in range(1, 8)] + [("c", 1, "c")]


def test_schemas():
    fields = [{"name": "id", "type": "int", "required": True}, {"name": "doc", "type": "json"}]
    got = schema.struct_from_fields(fields)
    assert got["id"].nullable is False and got["doc"].dataType.simpleString() == "variant"
    doc = {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "object"}}}
    assert [f.dataType.simpleString() for f in schema.struct_from_json_schema(doc)] == ["bigint", "variant"]


def test_table_ddl():
    ddl = W.table_ddl("t", [{"name": "id", "type": "SERIAL", "primary_key": True}, {"name": "doc", "type": "JSON", "nullable": True}])
    assert ddl == ("CREATE TABLE IF NOT EXISTS t (`id` BIGINT NOT NULL, `doc` STRING) USING parquet "
                   "TBLPROPERTIES ('primary_key' = 'id')")
    assert "VARCHAR(36) NOT NULL" in W.table_ddl("t")


def test_sink_options():
    assert render.kafka_sink_options(["b:1"], "zstd")["kafka.compression.type"] == "zstd"
    with pytest.raises(ValueError):
        render.kafka_sink_options(["b:1"], "rar")
    assert W.batching_options(10, "5 seconds") == {"options": {"maxRecordsPerFile": "10", "batchsize": "10"},
                                                   "trigger": {"processingTime": "5 seconds"}}


def test_named_nodes(spark):
    frames = {"a": spark.range(3), "b": spark.range(10, 12)}
    out = dataflow.connect(frames, {
        "late": {"inputs": ["both"], "type": "filter", "config": {"condition": ".id >= 2"}},
        "both": {"inputs": ["a", "b"]}})
    assert out["both"].count() == 5 and out["late"].count() == 3
    with pytest.raises(ValueError):
        dataflow.connect(frames, {"x": {"inputs": ["y"]}, "y": {"inputs": ["x"]}})


def test_unknown_stage(spark):
    with pytest.raises(ValueError):
        dataflow.apply_stage(spark.range(1), {"type": "no such stage"})


def test_expansion_counts_repeats(spark):
    parent = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "x")], "a int, b string")
    child = spark.createDataFrame([(1, "x", 10), (1, "x", 11), (2, "x", 12), (2, "y", 13)], "a int, b string, n int")
    got = X.expand(parent, child, {"a": "a", "b": "b"})
    assert sorted(r["n"] for r in got.collect()) == [10, 10, 11, 11, 13]
    assert X.expand(parent.limit(0), child, {"a": "a"}, stored_parent=parent).count() == 2 * 2 + 2


def test_hierarchy_with_missing_parent_and_cycle(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "f"), ("f", "e")], "id string, up string")
    got = {r["id"]: r["depth"] for r in X.hierarchy_depth(df, "id", "up").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 1, "e": None, "f": None}
    capped = {r["id"]: r["depth"] for r in X.hierarchy_depth(df, "id", "up", 10).collect()}
    assert capped["e"] == capped["f"] == 10
    long = spark.range(30).select(F.col("id"), F.nullif(F.col("id"), F.lit(0)).alias("x")).select("id", (F.col("x") - 1).alias("up"))
    assert {r["id"]: r["depth"] for r in X.hierarchy_depth(long, "id", "up", 10).collect()} == {i: min(i + 1, 10) for i in range(30)}
    assert {r["id"]: r["depth"] for r in X.hierarchy_depth(long, "id", "up").collect()} == {i: i + 1 for i in range(30)}


def test_soft_delete_now_and_kept_body(spark):
    log = spark.createDataFrame([(1, 1, "c", "x"), (1, 2, "d", None), (2, 3, "c", "y")], "id int, seq int, op string, body string")
    policy = H.DeletePolicy("soft", "custom", "gone_at", "$now", method="event_type", detect_field="op", detect_value="d")
    got = {r["id"]: (r["body"], r["gone_at"]) for r in H.apply_changes(log, ["id"], ["seq"], policy, "seq", ["op"]).collect()}
    assert got == {1: ("x", 2), 2: ("y", None)}


def test_average_latency():
    assert statistics.average_latency([10, 30]) == 20
    assert statistics.average_latency([]) is None


def test_one_object_and_nothing_else(spark):
    """Texts with something behind the object, which a parser that stops at its end would take."""
    import json

    from sluice.functions.scalars import json_object

    texts = ['{"a":1}', ' {"a":1} \n', '{"a":1}] x', '{"a":1}],[{"b":2}', '{"a":1} {"b":2}', '{"a":"}"}', '{"a":[{"b":1}]}', '{"a":[{"b":1}]}]', '{"a":"x}]"}',
             '{"a":"} ]"} ]', "[1]", "", "{}", '{"a":1}}', '{"a":{}},{"b":1}', '{"a":[{}]},"_":{"c":1}', None, "{a}"]

    def is_object(text):
        try:
            return isinstance(json.loads(text or ""), dict)
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_object(F.col("t")).isNotNull().alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == {t: is_object(t) for t in texts}


def test_validated_write_checks_every_row_once(spark):
    """One scan of the source; a sink without an action keeps nobody waiting."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(100).select("id", (F.col("id") % 30).cast("double").alias("value")).mapInArrow(counted, "id long, value double")
    rules = {"fields": [{"name": "value", "type": "number", "max": 20}]}
    kept = []
    counts = W.write_validated(df, rules, kept.append, kept.append)
    assert counts == {"valid": 73, "invalid": 27} and reads.value == 100
    assert [k.count() for k in kept] == [73, 27] and reads.value == 100 and kept[0].columns == ["id", "value"]
    path = scratch_path(spark, "split")
    assert W.split_validated(df.filter("value < 5"), rules, path) == {"valid": 20, "invalid": 0}
    assert spark.read.parquet(path).count() == 20


def test_parameters_leave_quoted_text_alone():
    assert tables.bind("SELECT ':a', \":b\", :a, x::int, 'it''s :a' FROM t WHERE b = :b", {"a": 1, "b": "o'x"}) == \
        "SELECT ':a', \":b\", 1, x::int, 'it''s :a' FROM t WHERE b = 'o''x'"


def test_avro_records_as_reader_schemas():
    import json

    from pyspark.sql import types as T

    record = lambda *fields: json.dumps({"type": "record", "name": "R", "namespace": "n", "fields": [{"name": f"f{i}", "type": f} for i, f in enumerate(fields)]})
    decimal = {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}
    inner = {"type": "record", "name": "I", "fields": [{"name": "x", "type": ["null", "long"]}]}
    got = schema.struct_from_avro(record("int", ["null", "string"], decimal, {"type": "map", "values": ["null", "float"]}, {"type": "array", "items": inner},
                                         "n.I", "I", ["int", "string"], {"type": "int", "logicalType": "date"}, {"type": "fixed", "name": "F", "size": 4},
                                         {"type": "string", "logicalType": "uuid"}, {"type": {"type": "long"}}, "null"))
    assert [f.dataType.simpleString() for f in got] == [
        "int", "string", "decimal(9,2)", "map<string,float>", "array<struct<x:bigint>>", "struct<x:bigint>", "struct<x:bigint>",
        "struct<member0:int,member1:string>", "date", "binary", "string", "bigint", "void"]
    assert [f.nullable for f in got][:3] == [False, True, False] and got["f4"].dataType.elementType["x"].nullable and got["f3"].dataType.valueContainsNull
    for wrong in ('"int"', record("other"), '{"type": "record", "name": "R", "fields": [{"name": "a", "type": {"type": "decimals"}}]}'):
        with pytest.raises(ValueError):
            schema.struct_from_avro(wrong)
    assert schema.source_schema("infer") is None and isinstance(schema.source_schema("x", fields=[{"name": "a", "type": "int"}]), T.StructType)
    with pytest.raises(ValueError):
        schema.source_schema("avro")
