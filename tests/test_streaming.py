"""Streams over several micro-batches, against sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators.throttling import throttle
from sluice.session import scratch_path
from sluice.streaming import dedup, realtime as RT, run
from sluice.streaming.state import KeyedState

SCHEMA = "id bigint, k bigint, s bigint, event_type string, ts timestamp"


def feed(spark, rows, parts=3):
    """Rows as a stream of ``parts`` files, one per micro-batch, in order."""
    path = scratch_path(spark, "feed")
    size = -(-len(rows) // parts)
    for i in range(parts):
        df = spark.createDataFrame(rows[i * size:(i + 1) * size], "id bigint, k bigint, s bigint, event_type string")
        df.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    return lambda: run.stream_table(spark, path, SCHEMA, max_files=1)


def make_events(count=240, seed=5, copies=False):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 1, 2]), i * 3 + rng.randrange(3), rng.choice(["CREATE", "UPDATE", "DELETE", "OTHER"]))
            for i in range(count)]
    if copies:
        rows = sorted(rows + [(i, k, s + 50, e) for i, k, s, e in rows if i % 3 == 0], key=lambda r: (r[2], r[0]))
    return rows


def model(rows, keep=lambda kind: True, ids=True):
    """The realtime chain, one event at a time: written (id, type) pairs."""
    alive, seen, out = {}, set(), []
    for i, k, s, kind in rows:
        if ids and i in seen:
            continue
        if kind == "UPDATE" and not alive.get(k):
            kind = "CREATE"
        if not keep(kind):
            continue
        if kind != "OTHER":
            alive[k] = kind != "DELETE"
        seen.add(i)
        out.append((i, s, kind))
    return sorted(out)


def written(df):
    return sorted((r["id"], r["s"], r["event_type"]) for r in df.select("id", "s", "event_type").collect())


CREATED = {"field": "event_type", "op": "in", "value": ["CREATE", "DELETE"]}


def test_stateful_chain(spark):
    rows = make_events(copies=True)
    out = run.run_to_table(RT.realtime(feed(spark, rows)(), ["k"], ["s", "id"], condition=CREATED, id_field="id"), "out", timers=True)
    assert written(out) == model(rows, lambda kind: kind in ("CREATE", "DELETE"))


def table_chain(spark, rows, condition, ids):
    out = scratch_path(spark, "out")
    marks = dedup.WrittenEvents(spark, scratch_path(spark, "ids"), "id") if ids else None
    chain = RT.TableChain(spark, scratch_path(spark, "entities"), ["k"], "k bigint", ["s", "id"], "event_type", condition, marks)
    run.run_batches(feed(spark, rows)(), chain.handler(dedup.batch_store(spark, out)), "chain")
    return written(spark.read.parquet(out))


def test_table_chain_with_copies(spark):
    rows = make_events(copies=True)
    assert table_chain(spark, rows, None, True) == model(rows)


def test_table_chain_with_type_filter(spark, small_blocks):
    rows = make_events(seed=9)
    assert table_chain(spark, rows, CREATED, False) == model(rows, lambda kind: kind in ("CREATE", "DELETE"), ids=False)


def test_type_filter_with_ids_is_refused(spark):
    marks = dedup.WrittenEvents(spark, scratch_path(spark, "ids"), "id")
    with pytest.raises(ValueError):
        RT.TableChain(spark, scratch_path(spark, "e"), ["k"], "k bigint", ["s"], "event_type", ".event_type == 'CREATE'", marks)


def test_retried_batch_gives_the_same_rows(spark):
    ids = dedup.WrittenEvents(spark, scratch_path(spark, "ids"), "id")
    store = dedup.batch_store(spark, scratch_path(spark, "out"))
    batch = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 0), (None, 1)], "id bigint, copy int")
    handle = ids.handler(store, ["copy"])
    handle(batch, 0)
    handle(batch, 0)
    assert ids.unseen(batch, 0, ["copy"]).count() == 4
    assert ids.unseen(batch, 1, ["copy"]).count() == 2


def test_filtered_event_does_not_block_its_copy(spark):
    ids = dedup.WrittenEvents(spark, scratch_path(spark, "ids"), "id")
    store = dedup.batch_store(spark, scratch_path(spark, "out"))
    handle = ids.handler(store, ["s"], before=lambda df: df.filter("s > 5"))
    first = spark.createDataFrame([(1, 1)], "id bigint, s int")
    handle(first, 0)
    assert ids.unseen(spark.createDataFrame([(1, 9)], "id bigint, s int"), 1, ["s"]).count() == 1


def test_expired_ids_pass_again(spark):
    ids = dedup.WrittenEvents(spark, scratch_path(spark, "ids"), "id", ttl_seconds=0)
    rows = spark.createDataFrame([(1, 1)], "id bigint, s int")
    ids.mark(rows, 0)
    assert ids.unseen(rows, 1, ["s"]).count() == 1


def limited(rows, strategy, rate, burst, span):
    """Admitted ids by a sequential limiter."""
    want, state = [], {}
    for i, k, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        now = s * 1_000_000
        if strategy == "fixed_window":
            slot = state.setdefault(k, {})
            slot[now // span] = slot.get(now // span, 0) + 1
            ok = slot[now // span] <= rate + burst
        elif strategy == "sliding_window":
            recent = [t for t in state.get(k, []) if t > now - span]
            ok = len(recent) < rate + burst
            state[k] = recent + [now] * ok
        else:
            tokens, at = state.get(k, (float(rate + burst), now))
            tokens = min(rate + burst, tokens + (now - at) * rate / span)
            ok = tokens >= 1 - 1e-9
            state[k] = (tokens - ok, now)
        want += [i] * ok
    return sorted(want)


@pytest.mark.parametrize("strategy", sorted(RT.STRATEGIES))
def test_throttle(spark, strategy):
    rows = make_events()
    want = limited(rows, strategy, 6, 2, 60_000_000)
    out = run.run_to_table(RT.throttle(feed(spark, rows)(), ["k"], "ts", "id", 6, "minute", 2, strategy), "out")
    assert sorted(r["id"] for r in out.collect()) == want
    target = scratch_path(spark, "out")
    table = RT.ThrottleTable(spark, scratch_path(spark, "limits"), ["k"], "ts", "id", 6, "minute", 2, strategy)
    run.run_batches(feed(spark, rows)(), table.handler(dedup.batch_store(spark, target)), "limit")
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == want


@pytest.mark.parametrize("strategy", sorted(RT.STRATEGIES))
def test_throttle_as_batch(spark, strategy):
    rows = make_events(600, seed=3)
    df = spark.createDataFrame(rows, "id bigint, k bigint, s bigint, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = throttle(df.repartition(3), ["k"], "ts", "id", 4, "minute", 1, strategy)
        assert sorted(r["id"] for r in out.collect()) == limited(rows, strategy, 4, 1, 60_000_000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("strategy", sorted(RT.STRATEGIES))
def test_throttle_of_a_hot_key(spark, small_blocks, strategy):
    """One key over many blocks, with and without gaps; ties are unique per key only."""
    rows = [(i, 1, i // 2 if i < 200 else 5000 + i * 40 + (i % 7) * 90, "A") for i in range(400)]
    rows += [(i, 2, 3, "A") for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, s bigint, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["k"], r["id"]) for r in throttle(df.repartition(3), ["k"], "ts", "id", 4, "minute", 1, strategy).collect())
    want = sorted((k, i) for k in (1, 2) for i in limited([r for r in rows if r[1] == k], strategy, 4, 1, 60_000_000))
    assert got == want


def test_latest_over_batches(spark):
    rows = make_events()
    newest = RT.latest(feed(spark, rows)(), ["k"], ["s", "id"])
    table = RT.LatestTable(spark, scratch_path(spark, "latest"), newest.schema, ["k"])
    run.run_batches(newest, table.handle, "latest", mode="update")
    want = {k: max((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))[0] for k in {r[1] for r in rows}}
    assert {r["k"]: r["id"] for r in table.current().collect()} == want


def test_restart_reads_only_new_files(spark):
    rows = make_events(60)
    stream = feed(spark, rows)
    state, out = scratch_path(spark, "state"), scratch_path(spark, "out")
    run.run_to_table(stream(), "out", state, out)
    assert run.run_to_table(stream(), "out", state, out).count() == 60


def test_dedup_within_watermark(spark):
    rows = make_events(copies=True)
    out = run.run_to_table(dedup.dedup_within(feed(spark, rows)(), "id", "ts", "1 hour"), "out")
    assert sorted(r["id"] for r in out.collect()) == sorted({r[0] for r in rows})


def test_processing_time_dedup(spark):
    rows = make_events(copies=True)
    out = run.run_to_table(dedup.dedup_ttl(feed(spark, rows)(), "id", 3600), "out")
    assert sorted(r["id"] for r in out.collect()) == sorted({r[0] for r in rows})


def test_idle_entity_holds_no_ids(spark):
    """Once its ids have expired, a timer clears the state of an entity that no row comes for any more."""
    import time

    path, state = scratch_path(spark, "feed"), scratch_path(spark, "state")
    out = scratch_path(spark, "out")
    put = lambda rows: (spark.createDataFrame(rows, "id bigint, k bigint, s bigint, event_type string").withColumn("ts", F.timestamp_seconds("s"))
                        .coalesce(1).write.mode("append").parquet(path))
    go = lambda: run.run_to_table(RT.realtime(run.stream_table(spark, path, SCHEMA), ["k"], ["s", "id"], id_field="id", ttl_seconds=4),
                                  "out", state, out, timers=True)
    put([(1, 1, 1, "CREATE"), (2, 2, 2, "DELETE"), (3, 3, 3, "UPDATE")])
    go()
    assert sorted(i for ids in held_ids(spark, state).values() for i in ids) == ["1", "2", "3"]
    time.sleep(5)
    put([(4, 9, 9, "CREATE")])
    go()
    left = held_ids(spark, state)
    # Entities 1 and 3 exist and keep that; 2 is gone with all of its state.
    assert sorted(left) == [1, 3, 9] and left[1] == left[3] == [] and left[9] == ["4"]
    put([(1, 1, 20, "UPDATE"), (5, 2, 21, "UPDATE")])
    rows = {(r["id"], r["s"]): r["event_type"] for r in go().collect()}
    assert rows[1, 20] == "UPDATE" and rows[5, 21] == "CREATE"


def held_ids(spark, state):
    """ids in the state of every entity."""
    rows = spark.read.format("statestore").load(state).select("key.*", "value.groupState").collect()
    return {int(r[0]): list(r[1]["ids"]) for r in rows}


def bytes_read(state, batch_id):
    system, _ = state._folder(state.path)
    return sum(system.getContentSummary(state._folder(p)[1]).getLength() for p in state.files(batch_id))


def test_state_read_per_batch_does_not_grow(spark):
    """30 batches over the same keys: what a batch reads stays level, and files that no batch needs are gone."""
    from sluice.operators.blocks import first_rows
    from sluice.streaming.state import KeyedState

    state = KeyedState(spark, scratch_path(spark, "keyed"), "k bigint, v bigint, batch bigint", ["k"],
                       lambda rows: first_rows(rows, ["k"], [F.desc("batch")]), classes=4)
    sizes = []
    for b in range(30):
        sizes.append(bytes_read(state, b))
        state.put(spark.range(40).select(F.col("id").alias("k"), (F.col("id") + b).alias("v"), F.lit(b).cast("bigint").alias("batch")).filter(f"k % 3 = {b % 3}"), b)
    assert max(sizes[20:]) <= 1.3 * max(sizes[8:14])
    got = {r["k"]: r["v"] for r in state.current().collect()}
    assert got == {k: k + max(b for b in range(30) if b % 3 == k % 3) for k in range(40)}
    assert len(state._names(f"{state.home}/snapshots")) <= 6 and len(state._names(f"{state.home}/deltas")) <= 6
    # A retried batch starts from the same state and replaces what it wrote.
    before = sorted(map(tuple, state.before(29).collect()))
    state.put(spark.range(40).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("v"), F.lit(29).cast("bigint").alias("batch")).filter("k = 5"), 29)
    assert sorted(map(tuple, state.before(29).collect())) == before
    assert {r["k"]: r["v"] for r in state.current().collect()}[5] == 0


def test_new_query_over_an_old_state_goes_on_from_it(spark):
    """A second checkpoint over the same path counts its batches from 0; it sees the first one's marks and overwrites none."""
    path, out = scratch_path(spark, "ids"), scratch_path(spark, "out")
    rows = make_events(40)
    for part in (rows[:30], rows[10:]):
        marks = dedup.WrittenEvents(spark, path, "id")
        store = dedup.batch_store(spark, f"{out}/{len(part)}-{part[0][0]}")
        run.run_batches(feed(spark, part)(), marks.handler(store, ["s"]), "dedup")
    first, second = (sorted(r["id"] for r in spark.read.parquet(f"{out}/30-{i}").select("id").collect()) for i in (0, 10))
    assert first == list(range(30)) and second == list(range(30, 40))


def test_windows_late_rows_and_the_end_of_the_input(spark):
    from sluice.streaming.windows import WindowTable

    # Batch 2 brings rows of a window that batch 1 has closed.
    rows = [(1, 0, 30, "A"), (2, 0, 200, "A"), (3, 0, 40, "B"), (4, 0, 190, "B"), (5, 1, 400, "A"), (6, 0, 70, "B")]
    path, label = scratch_path(spark, "windows"), {"n": ("count", None), "top": ("max", "s"), "mean": ("avg", "s")}
    stream = feed(spark, rows)()
    table = WindowTable(spark, path, stream.schema, "ts", label, ["k"], "60 seconds", None, "10 seconds")
    run.run_batches(stream, table.handle, "windows")
    rows = lambda df: sorted((int(r["window_start"].timestamp()), r["k"], r["n"], r["top"], r["mean"]) for r in df.collect())
    assert rows(table.finish()) == [(0, 0, 1, 30, 30.0), (180, 0, 2, 200, 195.0), (360, 1, 1, 400, 400.0)]
    assert rows(table.late()) == [(0, 0, 1, 40, 40.0), (60, 0, 1, 70, 70.0)]


def test_polled_table_goes_on_from_its_checkpoint(spark):
    from sluice.sources.tables import page_end
    from sluice.streaming.polled import PolledTable

    path, state, out = (scratch_path(spark, n) for n in ("table", "state", "out"))
    put = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id bigint, v string").write.mode("append").parquet(path)
    put([*range(1, 40), 10_000_000, 10_000_001, 90_000_000_000])
    load = lambda: spark.read.parquet(path)
    assert [page_end(load(), a, "id", 10) for a in (0, 35, 10_000_001, 90_000_000_000)] == [10, 90_000_000_000, 90_000_000_000, None]
    polled = lambda: PolledTable(spark, state, load, batch_size=10)
    checkpoint = scratch_path(spark, "checkpoint")
    assert polled().drain(dedup.batch_store(spark, out), checkpoint, most=2) >= 2
    put([90_000_000_001])
    polled().drain(dedup.batch_store(spark, out), checkpoint)
    got = [r["id"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [*range(1, 40), 10_000_000, 10_000_001, 90_000_000_000, 90_000_000_001]


def test_polled_stream_needs_few_jobs_a_page(spark):
    from sluice.streaming.polled import PolledTable

    path, state, out, checkpoint = (scratch_path(spark, n) for n in ("table", "state", "out", "checkpoint"))
    spark.range(1, 121).selectExpr("id", "id % 3 kind").write.parquet(path)
    store, groups = dedup.batch_store(spark, out), []

    def write(df, batch_id):
        groups.append(spark.sparkContext.getLocalProperty("spark.jobGroup.id"))
        return store(df, batch_id)

    polled = lambda: PolledTable(spark, state, lambda: spark.read.parquet(path), order_by="kind", batch_size=10)
    assert polled().drain(write, checkpoint, most=3) == 3
    assert polled().drain(write, checkpoint) == 9
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(groups[-1]))
    assert jobs <= 3 * 9 + 20  # reading the schema, the page, and what the clock stream runs
    spark.range(121, 126).selectExpr("id", "id % 3 kind").write.mode("append").parquet(path)
    assert polled().drain(write, checkpoint) == 1
    got = spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in got] == [(a, min(a + 9, 125)) for a in range(1, 122, 10)] and sum(r["n"] for r in got) == 125


def test_state_of_one_key_written_by_the_driver(spark):
    """Read like what ``put`` writes, by later batches, retries, and the next query."""
    merge = lambda rows: rows.groupBy("name").agg(F.max("last").alias("last"))
    path = scratch_path(spark, "state")
    state = KeyedState(spark, path, "name string, last bigint", ["name"], merge, classes=2)
    before = []
    for n in range(7):
        before.append([r["last"] for r in state.before(n).collect()])
        put = [lambda row, n: state.put(spark.createDataFrame([row]), n), state.put_row][n % 3 != 1]
        put({"name": "all", "last": 10 * n}, n)
    assert before == [[], *([10 * n] for n in range(6))] and [r["last"] for r in state.before(6).collect()] == [50]
    state.put_row({"name": "all", "last": 55}, 6)
    assert [r["last"] for r in KeyedState(spark, path, "name string, last bigint", ["name"], merge, classes=2).current().collect()] == [55]
