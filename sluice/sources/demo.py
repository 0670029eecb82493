"""Generated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.functions.scalars import pick, random_int, rfc3339

# Levels and services of generated records.
LEVELS = ["debug", "info", "warn", "error"]
LOG_LEVELS = ["info", "warn", "error"]
SERVICES = ["api", "web", "worker"]


def demo_events(ids: DataFrame, id_column: str = "id", source: str = "demo", ts: Column | None = None,
                levels: list[str] = LEVELS) -> DataFrame:
    """Demo events for a table of ids: id, message, timestamp, level, source."""
    n = F.col(id_column)
    return ids.select(
        n.cast("bigint").alias("id"),
        F.concat(F.lit("Demo event "), n.cast("string")).alias("message"),
        rfc3339(ts if ts is not None else F.current_timestamp()).alias("timestamp"),
        pick(levels, n).alias("level"),
        F.lit(source).alias("source"),
    )


def generate(spark: SparkSession, count: int, source: str = "demo") -> DataFrame:
    """``count`` demo events, numbered from 1."""
    return demo_events(spark.range(1, count + 1), source=source)


def generate_stream(spark: SparkSession, per_second: int = 1, source: str = "demo") -> DataFrame:
    """Demo events at a steady rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return demo_events(ticks.withColumn("value", F.col("value") + 1), "value", source, F.col("timestamp"))


def sample_logs(ids: DataFrame, seed: int = 0) -> DataFrame:
    """Log records with random level, service, message, latency and user."""
    return ids.select(
        F.uuid().alias("id"),
        F.current_timestamp().alias("timestamp"),
        pick(LOG_LEVELS, random_int(3, seed)).alias("level"),
        pick(SERVICES, random_int(3, seed + 1)).alias("service"),
        F.concat(F.lit("Sample log message "), random_int(1_000_000, seed + 2).cast("string")).alias("message"),
        random_int(1000, seed + 3).alias("latency_ms"),
        F.concat(F.lit("user_"), random_int(100, seed + 4).cast("string")).alias("user_id"),
    )
