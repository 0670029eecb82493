"""Session helpers: storage for intermediate results and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Rows one task may hold for one key before the key is split over blocks.
ROWS_PER_BLOCK_CONF = "spark.sluice.rowsPerBlock"
ROWS_PER_BLOCK = 4_000_000


def get_spark(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sluice")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; where it names none, a fresh local one, which only a session
    without executors of its own can use."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def put_rows(spark: SparkSession, path: str, rows: pa.Table) -> None:
    """Write a few rows as one parquet file from the driver, without a job; the file is there whole or not at all."""
    data = pa.BufferOutputStream()
    pq.write_table(rows, data)
    folder, _, name = path.rpartition("/")
    target, part = (spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (name, f"_{name}"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part, True)
    out.write(bytearray(data.getvalue().to_pybytes()))
    out.close()
    if not system.rename(part, target):
        raise OSError(f"{path} was not written")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the stored copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_per_block(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_BLOCK_CONF, str(ROWS_PER_BLOCK)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
