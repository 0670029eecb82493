"""Event de-duplication on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice.operators.blocks import first_rows
from sluice.streaming.state import KeyedState


def _without_id(df: DataFrame, id_field: str):
    blank = F.col(id_field).isNull()
    if isinstance(df.schema[id_field].dataType, T.StringType):
        blank = blank | (F.col(id_field) == "")
    return blank


def dedup_within(stream: DataFrame, id_field: str, ts: str, ttl: str = "24 hours") -> DataFrame:
    """Drop an event whose id came less than ``ttl`` (event time) before; events without an id
    always pass.  Put filters in front: a filtered event must not block its duplicate."""
    blank = _without_id(stream, id_field)
    timed = stream.withWatermark(ts, ttl)
    unique = timed.filter(~blank).dropDuplicatesWithinWatermark([id_field])
    return unique.unionByName(timed.filter(blank))


def dedup_ttl(stream: DataFrame, id_field: str, ttl_seconds: int = 86_400) -> DataFrame:
    """Drop an event whose id was let through less than ``ttl_seconds`` (processing time) ago.

    The arrival time serves as event time.  A mark lasts one delay and the watermark trails by
    another, so the delay is half the time to live.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp())
    return dedup_within(arrived, id_field, "_arrived", f"{ttl_seconds * 500} milliseconds").drop("_arrived")


class WrittenEvents:
    """De-duplication against the ids of events that were written, kept as a compacted table.

    Meant for ``foreachBatch``.  Within a batch, copies are cut to one per task before they are
    shuffled, so an event repeated any number of times costs nothing extra.  Ids are marked only
    after the sink has written, they expire ``ttl_seconds`` after that and leave the table when it is rewritten next, and a batch that is
    retried ignores its own earlier marks.
    """

    def __init__(self, spark: SparkSession, path: str, id_field: str, id_type: str = "bigint",
                 ttl_seconds: int = 86_400):
        self.spark, self.id_field, self.ttl = spark, id_field, ttl_seconds
        self.state = KeyedState(spark, path, f"{id_field} {id_type}, marked_at timestamp", [id_field], self._newest)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The last mark of each id that still counts."""
        oldest = F.current_timestamp() - F.expr(f"INTERVAL {self.ttl} SECONDS")
        return rows.filter(F.col("marked_at") > oldest).groupBy(self.id_field).agg(F.max("marked_at").alias("marked_at"))

    def marked(self, batch_id: int) -> DataFrame:
        """Ids that still count, without those of this batch."""
        return self.state.before(batch_id).select(self.id_field)

    def unseen(self, batch: DataFrame, batch_id: int, order: list[str]) -> DataFrame:
        """First copy of each event that was not written before."""
        blank = _without_id(batch, self.id_field)
        fresh = (first_rows(batch.filter(~blank), [self.id_field], [F.asc(o) for o in order])
                 .join(self.marked(batch_id), self.id_field, "left_anti").select(*batch.columns))
        return fresh.unionByName(batch.filter(blank))

    def mark(self, written: DataFrame, batch_id: int) -> None:
        self.state.put(written.filter(~_without_id(written, self.id_field)).select(
            self.id_field, F.current_timestamp().alias("marked_at")), batch_id)

    def handler(self, write: Callable[[DataFrame, int], DataFrame], order: list[str],
                before: Callable[[DataFrame], DataFrame] = lambda df: df):
        """``foreachBatch`` function: filter, de-duplicate, write, mark.

        ``write`` stores the batch and returns the stored rows, which are the ones marked.
        """
        def handle(batch: DataFrame, batch_id: int) -> None:
            self.mark(write(self.unseen(before(batch), batch_id, order), batch_id), batch_id)

        return handle


def batch_store(spark: SparkSession, path: str) -> Callable[[DataFrame, int], DataFrame]:
    """A sink that replaces its own batch on a retry, and returns what it stored."""
    def write(df: DataFrame, batch_id: int) -> DataFrame:
        target = f"{path}/batch={batch_id}"
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target)

    return write
