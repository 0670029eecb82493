"""Running streams over files, and counting what passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sluice.session import scratch_path

# Files one micro-batch may read; bounds the rows a stateful operator sees at once.
MAX_FILES = 100


def stream_table(spark: SparkSession, path: str, schema, max_files: int = MAX_FILES) -> DataFrame:
    """Parquet files as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def with_event_time(df: DataFrame, ts: str) -> DataFrame:
    """The time column as TIMESTAMP, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_table(stream: DataFrame, label: str, checkpoint: str | None = None, path: str | None = None, timers: bool = False) -> DataFrame:
    """Process what is available, append it to a parquet table in the shared folder, and read it.

    A stream with ``timers`` on processing time always has another empty batch to run; they are left to the next run's batches.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, f"{label}-state")
    path = path or scratch_path(spark, label)
    before = spark.conf.get(EMPTY_BATCHES)
    if timers:
        spark.conf.set(EMPTY_BATCHES, "false")
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                 .option("path", path).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle, label: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Process what is available through ``handle(batch, batch_id)``."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{label}-state")
    query = (stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


class Progress(StreamingQueryListener):
    """Input, output, filtered and error rows of the streams of a session.

    The stream carries an ``observe`` named ``sluice`` with ``output`` and ``errors``.
    """

    def __init__(self):
        self.input = self.output = self.errors = 0
        self.last_record = None
        self.durations: list[int] = []

    @property
    def filtered(self) -> int:
        return self.input - self.output - self.errors

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.input += p.numInputRows
        self.durations.append(p.batchDuration)
        seen = p.observedMetrics.get("sluice")
        if seen is not None:
            self.output += seen["output"]
            self.errors += seen["errors"]
        if p.numInputRows:
            self.last_record = p.timestamp

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def observed(stream: DataFrame, error=None) -> DataFrame:
    """Count rows that come through, and rows with an error, for ``Progress``."""
    bad = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    return stream.observe("sluice", F.count_if(~bad).alias("output"), F.count_if(bad).alias("errors"))
