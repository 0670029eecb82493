"""Event time on streams: late rows told apart, and windows that are complete at the end of a bounded input.

Spark's own watermark drops late rows without a trace and holds back the last windows until later rows arrive.  These operators work in
``foreachBatch`` with the greatest event time of all earlier batches, which is stored; a batch that is retried is judged by the same time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sluice.operators.aggregates import window_aggregate
from sluice.streaming.state import KeyedState

# Partial aggregates of a function, and how partials are put together again.
_PARTS = {"count": [("count", "sum")], "sum": [("sum", "sum")], "min": [("min", "min")], "max": [("max", "max")],
          "avg": [("sum", "sum"), ("count", "sum")]}
_TOGETHER = {"sum": F.sum, "min": F.min, "max": F.max}


class Watermark:
    """The greatest event time of a stream's earlier batches, less ``delay``."""

    def __init__(self, spark: SparkSession, path: str, ts: str, delay: str):
        self.ts, self.delay = ts, delay
        self.state = KeyedState(spark, path, "name string, top timestamp", ["name"],
                                lambda rows: rows.groupBy("name").agg(F.max("top").alias("top")), classes=2)

    def before(self, batch_id: int):
        """The mark that rows of this batch are measured by; None in the first batch."""
        return self._mark(self.state.before(batch_id))

    def after(self):
        """The mark once the last batch that was noted has counted."""
        return self._mark(self.state.current())

    def _mark(self, state: DataFrame):
        return state.select((F.col("top") - F.expr(f"INTERVAL {self.delay}")).alias("mark")).agg(F.max("mark")).first()[0]

    def note(self, batch: DataFrame, batch_id: int) -> None:
        top = batch.agg(F.max(F.col(self.ts).cast("timestamp")).alias("top")).select(F.lit("all").alias("name"), "top")
        self.state.put(top.filter(F.col("top").isNotNull()), batch_id)


def _late(ts: str, mark) -> Column:
    return F.coalesce(F.col(ts).cast("timestamp") < F.lit(mark).cast("timestamp"), F.lit(False)) if mark is not None else F.lit(False)


class LateRows:
    """Splits a stream by its watermark: rows that count go one way, late ones to a table of their own.

    A row is late when its time lies more than ``delay`` before the greatest time of the batches before its own.  Rows without a
    time are never late.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str, delay: str):
        self.ts, self.watermark = ts, Watermark(spark, f"{path.rstrip('/')}/times", ts, delay)

    def handler(self, write: Callable[[DataFrame, int], object], write_late: Callable[[DataFrame, int], object]):
        def handle(batch: DataFrame, batch_id: int) -> None:
            late = _late(self.ts, self.watermark.before(batch_id))
            write(batch.filter(~late), batch_id)
            write_late(batch.filter(late), batch_id)
            self.watermark.note(batch, batch_id)

        return handle


class WindowTable:
    """Aggregates per time window and key for ``foreachBatch``.

    Each batch is aggregated to partial windows, which are put together with those of earlier batches in a compacted table.  A
    window is written when the watermark has passed its end; rows that come for it later go to the table of late rows, once for
    every window they miss.  ``finish`` writes the windows that are still open when a bounded input ends.  Rows without a time
    belong to no window.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, ts: str, aggregates: dict[str, tuple[str, str | None]],
                 group_by: list[str] = (), size: str = "60 seconds", slide: str | None = None, delay: str = "0 seconds"):
        self.spark, self.path, self.ts, self.aggregates, self.group_by = spark, path.rstrip("/"), ts, aggregates, list(group_by)
        self.frame = (size, slide)
        self.watermark = Watermark(spark, f"{self.path}/times", ts, delay)
        self.parts = {f"{name}_{i}": (part, source, together) for name, (function, source) in aggregates.items()
                      for i, (part, together) in enumerate(_PARTS[function])}
        empty = self._partial(spark.createDataFrame([], schema))
        self.keys = ["window_start", "window_end", *self.group_by]
        self.state = KeyedState(spark, f"{self.path}/open", empty.schema, self.keys, self._together)
        # Windows that end up to here are written, and leave the table when it is rewritten.
        self.written = None

    def _partial(self, rows: DataFrame) -> DataFrame:
        return window_aggregate(rows, self.ts, {name: (part, source) for name, (part, source, _) in self.parts.items()}, self.group_by, *self.frame)

    def _together(self, rows: DataFrame) -> DataFrame:
        if self.written is not None:
            rows = rows.filter(F.col("window_end") > F.lit(self.written).cast("timestamp"))
        return rows.groupBy(*self.keys).agg(*[_TOGETHER[together](name).alias(name) for name, (_, _, together) in self.parts.items()])

    def _whole(self, rows: DataFrame) -> DataFrame:
        """Partial aggregates as the results asked for."""
        out = [(F.try_divide(f"{name}_0", f"{name}_1") if function == "avg" else F.col(f"{name}_0")).alias(name)
               for name, (function, _) in self.aggregates.items()]
        return rows.select(*self.keys, *out)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        mark = self.written = self.watermark.before(batch_id)
        passed = F.col("window_end") <= F.lit(mark).cast("timestamp") if mark is not None else F.lit(False)
        partial = self._partial(batch)
        self._whole(partial.filter(passed)).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        self.state.put(partial.filter(~passed), batch_id)
        self.watermark.note(batch, batch_id)
        now = self.watermark.after()
        ended = F.col("window_end") <= F.lit(now).cast("timestamp") if now is not None else F.lit(False)
        self._whole(self.state.current().filter(ended)).write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id}")

    def finish(self) -> DataFrame:
        """All windows of the input: those that were closed on the way, and those that were open when it ended."""
        now = self.watermark.after()
        rest = self.state.current()
        if now is not None:
            rest = rest.filter(F.col("window_end") > F.lit(now).cast("timestamp"))
        left = self._whole(rest)
        return self.spark.read.schema(left.schema).parquet(f"{self.path}/closed").select(*left.columns).unionByName(left)

    def late(self) -> DataFrame:
        """Aggregates of rows that came after their window was written."""
        schema = self._whole(self.state.current()).schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/late").select(*schema.names)
