"""Run statistics: counters of one run, and rollups of stored run and hourly rows."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, functions as F

COUNTERS = ("records_collected", "records_processed", "collection_errors", "processing_errors")


def counted(df: DataFrame, name: str, error: Column | None = None) -> tuple[DataFrame, Observation]:
    """Count rows (and error rows) as they pass, at no extra pass over the data."""
    seen = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    if error is not None:
        metrics.append(F.count_if(error).alias("errors"))
    return df.observe(seen, *metrics), seen


def counted_chain(df: DataFrame, stages: list[tuple]) -> tuple[DataFrame, dict[str, Observation]]:
    """Run ``(name, stage)`` pairs in order with a counter before the first and after each."""
    df, source = counted(df, "source")
    seen = {"source": source}
    for name, stage in stages:
        df, seen[name] = counted(stage(df), name)
    return df, seen


def stage_statistics(seen: dict[str, Observation]) -> list[dict]:
    """Input, output and dropped rows of each stage, after the chain has run."""
    names = list(seen)
    rows = [seen[n].get["rows"] for n in names]
    return [{"stage": n, "input": a, "output": b, "dropped": max(a - b, 0)}
            for n, a, b in zip(names[1:], rows, rows[1:])]


def run_statistics(seen: dict[str, Observation], sinks: int, errors: int = 0, duration_ms: int = 0) -> dict:
    """Counters of one run; a record counts as written once per sink.

    ``errors`` and those that the last counter has seen are processing errors; those of the source's are collection errors.
    """
    found = {name: o.get for name, o in seen.items()}
    rows = {name: metrics["rows"] for name, metrics in found.items()}
    last = list(rows)[-1]
    return {
        "records_collected": rows["source"],
        "records_processed": rows[last] * sinks,
        "collection_errors": found["source"].get("errors", 0),
        "processing_errors": errors + (found[last].get("errors", 0) if last != "source" else 0),
        "per_stage_counts": {n: c for n, c in rows.items() if n != "source"},
        "duration_ms": duration_ms,
    }


def run_counted(df: DataFrame, stages: list[tuple], sinks: list[tuple], collection_error: Column | None = None,
                processing_error: Column | None = None) -> dict:
    """Run ``(name, stage)`` pairs into ``(condition, sink)`` pairs; the counters of the run.

    Rows and errors are counted as they pass: ``collection_error`` on the source's rows, ``processing_error`` on those that leave the last
    stage.  A sink that fails is one more processing error and does not keep the others from their rows.  The duration is that of
    reading, stages and sinks together.
    """
    from sluice.operators.predicates import where

    begun = time.monotonic()
    df, source = counted(df, "source", collection_error)
    seen = {"source": source}
    for name, stage in stages:
        df, seen[name] = counted(stage(df), name, processing_error if name == stages[-1][0] else None)
    rows = df.persist()
    failed = 0
    try:
        rows.count()  # the counters are complete whatever the sinks read
        for condition, sink in sinks:
            try:
                sink(where(rows, condition))
            except PySparkException:
                failed += 1
    finally:
        rows.unpersist()
    return run_statistics(seen, len(sinks) - failed, failed, round((time.monotonic() - begun) * 1000))


def _sums(columns=COUNTERS) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def hourly_buckets(runs: DataFrame, ts: str = "started_at", keys=("pipeline_id",)) -> DataFrame:
    """Counters per hour and pipeline, with the number of runs."""
    return (
        runs.withColumn("bucket_hour", F.date_trunc("hour", ts))
        .groupBy("bucket_hour", *keys)
        .agg(*_sums(), F.count(F.lit(1)).alias("sample_count"))
    )


def stage_totals(rows: DataFrame, keys: list[str], counts: str = "per_stage_counts") -> DataFrame:
    """Sum of a stage-count map per key and stage, long form."""
    return (
        rows.select(*keys, F.explode(counts).alias("stage", "n"))
        .groupBy(*keys, "stage").agg(F.sum("n").alias("n"))
    )


def merge_stage_counts(rows: DataFrame, keys: list[str], counts: str = "per_stage_counts") -> DataFrame:
    """One merged stage-count map per key.  Counts are summed first, so a map has one entry per
    stage of the pipeline whatever the number of rows."""
    entry = F.struct("stage", "n")
    return (
        stage_totals(rows, keys, counts).groupBy(*keys)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(counts))
    )


def workflow_totals(hourly: DataFrame, start, end, ts: str = "bucket_hour", where: Column | None = None) -> DataFrame:
    """Totals of the four counters in an inclusive time range; 0 when there is nothing."""
    kept = hourly.filter(F.col(ts).between(F.lit(start), F.lit(end)))
    if where is not None:
        kept = kept.filter(where)
    return kept.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in COUNTERS])


def per_pipeline(hourly: DataFrame, key: str = "pipeline_id") -> DataFrame:
    """Totals of the hourly rows per pipeline."""
    return hourly.groupBy(key).agg(*_sums())


def execution_totals(results: DataFrame, key: str = "execution_id") -> DataFrame:
    """Total and failed records per execution."""
    return results.groupBy(key).agg(F.sum("record_count").alias("total_records"),
                                    F.sum("error_count").alias("failed_records"))


def provider_hourly(rows: DataFrame, provider: str, ts: str, group: str, records: str, failed: str,
                    active: Column) -> DataFrame:
    """Records, failed records, groups and active groups per provider and hour.

    Grouped by group first, so that both counts of groups are plain sums and no row is multiplied for a distinct count.
    """
    per_group = (
        rows.withColumn("bucket_hour", F.date_trunc("hour", ts))
        .groupBy(provider, "bucket_hour", group)
        .agg(F.sum(records).alias("_records"), F.sum(failed).alias("_failed"), F.max(F.coalesce(active, F.lit(False))).alias("_active"))
    )
    named = F.col(group).isNotNull()
    return per_group.groupBy(provider, "bucket_hour").agg(
        F.sum("_records").alias("total_records"), F.sum("_failed").alias("failed_records"),
        F.count_if(named).alias("total_groups"), F.count_if(named & F.col("_active")).alias("active_groups"))


def throughput(rows: DataFrame, ts: str, failed: Column, keys: list[str] = (), per: str = "minute",
               seconds: int = 60) -> DataFrame:
    """Records per second and error rate of each time slot."""
    return (
        rows.withColumn("slot", F.date_trunc(per, ts))
        .groupBy("slot", *keys)
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(failed).alias("failed"))
        .withColumn("per_second", F.col("records") / seconds)
        .withColumn("error_rate", F.col("failed") / F.nullif(F.col("records"), F.lit(0)))
    )


def node_metrics(latest: DataFrame, key: str = "pipeline_id") -> DataFrame:
    """Count per drawn node of the latest run: source, stages from the count map, sink."""
    ends = F.array(F.struct(F.lit("source").alias("node"), F.col("records_collected").alias("n")),
                   F.struct(F.lit("sink").alias("node"), F.col("records_processed").alias("n")))
    stages = F.transform(F.map_entries("per_stage_counts"),
                         lambda e: F.struct(e["key"].alias("node"), e["value"].alias("n")))
    return latest.select(key, F.explode(F.concat(ends, stages)).alias("_e")).select(key, "_e.node", "_e.n")


def average_latency(spans: list[int]) -> float | None:
    """Mean batch duration in ms; ``streaming.run.Progress`` collects the durations of all batches."""
    return sum(spans) / len(spans) if spans else None
