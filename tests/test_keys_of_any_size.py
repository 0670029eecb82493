"""Splitting hot keys over blocks must not change a result."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators import blocks as B, changes as H, routing as R
from sluice.sources.files import group_lines


def events(spark, count=900, seed=1):
    """A third of all rows belongs to key 0; one key is NULL; timestamps repeat."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, None]), rng.randrange(3000), rng.choice(["CREATE", "UPDATE", "DELETE", "OTHER"]))
            for i in range(count)]
    return spark.createDataFrame(rows, "id bigint, k bigint, s bigint, event_type string") \
        .withColumn("ts", F.timestamp_seconds("s")).repartition(5)


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbered(spark, small_blocks, keys):
    df = events(spark)
    order = [F.desc("s"), F.asc("id")]
    split = B.numbered(df, keys, order, "n").select("id", "n").orderBy("id").collect()
    plain = B.numbered(df, keys, order, "n", split=False).select("id", "n").orderBy("id").collect()
    assert split == plain


def test_running_total(spark, small_blocks):
    df = events(spark)
    args = (["k"], [F.col("s"), F.col("id")], F.col("id") % 3, "t")
    split = B.running_total(df, *args).select("id", "t").orderBy("id").collect()
    assert split == B.running_total(df, *args, split=False).select("id", "t").orderBy("id").collect()


def test_upserts_equal_sequential_rule(spark, small_blocks):
    df = events(spark)
    got = {r["id"]: r["event_type"] for r in H.convert_upserts(df, ["k"], ["s", "id"]).collect()}
    alive, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["s"], r["id"])):
        kind = r["event_type"]
        if r["k"] is None:  # no entity, no rule
            want[r["id"]] = kind
            continue
        if kind == "UPDATE" and not alive.get(r["k"]):
            kind = "CREATE"
        if kind != "OTHER":
            alive[r["k"]] = kind != "DELETE"
        want[r["id"]] = kind
    assert got == want


@pytest.mark.parametrize("seconds", [1, 7, 60, 900, 5000])
def test_dedupe_within_equals_sequential_rule(spark, small_blocks, seconds):
    df = events(spark, seed=seconds)
    last, want = {}, set()
    for r in sorted(df.collect(), key=lambda r: (r["s"], r["id"])):
        if r["k"] not in last or r["s"] - last[r["k"]] >= seconds:
            last[r["k"]] = r["s"]
            want.add(r["id"])
    assert {r["id"] for r in H.dedupe_within(df, ["k"], "ts", "id", seconds).collect()} == want
    assert {r["id"] for r in H.dedupe_within(df, ["k"], "ts", "id", seconds, split=False).collect()} == want


def test_large_rank_limit(spark, small_blocks):
    df = events(spark)
    rows = df.toPandas().sort_values(["s", "id"])
    want = set(rows.groupby(rows["k"].fillna(-1)).head(1200)["id"])
    assert {r["id"] for r in B.first_rows(df, ["k"], [F.col("s"), F.col("id")], 1200).collect()} == want
    few = set(rows.groupby(rows["k"].fillna(-1)).head(3)["id"])
    assert {r["id"] for r in B.first_rows(df, ["k"], [F.col("s"), F.col("id")], 3).collect()} == few


def test_rank_is_cut_before_the_shuffle(spark):
    plan = B.first_rows(events(spark), ["k"], [F.col("s")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_round_robin_is_even(spark, small_blocks):
    out = R.round_robin(events(spark), ["a", "b", "c"], [F.col("s"), F.col("id")]).groupBy("_route").count().collect()
    assert {r["count"] for r in out} == {300}


def test_group_lines(spark, small_blocks):
    lines = [("f", i + 1, f"{'2024 ' if i % 7 == 3 else ' at '}{i}") for i in range(300)] + [("g", 1, "2024 only")]
    df = spark.createDataFrame(lines, "file string, line_no bigint, line string").repartition(4)
    entries: dict = {}
    current = {}
    for file, n, line in lines:
        if line.startswith("2024") or file not in current:
            current[file] = (file, n)
            entries[current[file]] = []
        entries[current[file]].append(line)
    got = {(r["file"], r["line_no"]): r["entry"].split("\n") for r in group_lines(df, "^2024").collect()}
    assert got == entries


def test_dedupe_strategies(spark):
    rows = pd.DataFrame({"k": [1, 1, 2], "seq": [1, 2, 3], "at": [9, 5, 1]})
    df = spark.createDataFrame(rows)
    pick = lambda s, f=None: sorted(r["seq"] for r in H.dedupe(df, ["k"], ["seq"], s, f).collect())
    assert pick("keep_first") == [1, 3] and pick("keep_last") == [2, 3] and pick("keep_latest", "at") == [1, 3]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_the_table_takes_one_exchange(spark, monkeypatch):
    """Rows are moved once, into ranges; nothing is counted before."""
    seen = []
    real = B.stored
    monkeypatch.setattr(B, "stored", lambda df: (seen.append(plan_of(df)), real(df))[1])
    df = events(spark)
    out = B.numbered(df, [], [F.desc("s"), F.asc("id")], "n")
    moved = seen[0].replace("RoundRobinPartitioning", "source")  # the fixture's own
    assert len(seen) == 1 and moved.count("rangepartitioning") == 1 and "hashpartitioning" not in moved and "Window" not in moved
    rows = sorted((r["n"], -r["s"], r["id"]) for r in out.collect())
    assert [n for n, _, _ in rows] == list(range(1, 901)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert B.numbered(df.filter("false"), [], [F.asc("id")], "n").count() == 0


def test_expansion_of_a_hot_parent_is_spread(spark):
    """Repeats of one parent come out of many tasks."""
    from sluice.operators import expand as X

    parent = spark.range(300_000).select(F.lit(7).alias("p")).unionByName(spark.createDataFrame([(1,), (1,), (2,)], "p int"))
    child = spark.createDataFrame([(7, "hot"), (1, "a"), (1, "b"), (3, "c")], "c int, name string")
    out = X.expand_for_each(parent, child, {"p": "c"})
    assert {r["name"]: r["count"] for r in out.groupBy("name").count().collect()} == {"hot": 300_000, "a": 2, "b": 2}
    tasks = out.filter("name = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) <= 0.6 * 300_000
