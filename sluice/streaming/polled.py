"""An event table that is polled by a stream, page after page, from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.sources.tables import Pages
from sluice.streaming.state import KeyedState


class PolledTable:
    """Pages of a growing table as micro-batches.

    A clock stream gives one micro-batch per poll.  A poll reads the next ``batch_size`` rows after the id where the batch before it ended, see
    ``Pages``; that id is kept with the state of the query.  A batch that is retried begins at the
    same id, and its sink replaces what the first try wrote.  ``load`` gives the table as it is at that moment.
    """

    def __init__(self, spark: SparkSession, path: str, load: Callable[[], DataFrame], id_column: str = "id", columns: list[str] | None = None,
                 condition=None, order_by: str | None = None, batch_size: int = 1000, start: int = 0):
        self.spark, self.load, self.start = spark, load, start
        self.pages = Pages(id_column, columns, condition, order_by, batch_size)
        self.state = KeyedState(spark, path, "name string, last bigint", ["name"],
                                lambda rows: rows.groupBy("name").agg(F.max("last").alias("last")), classes=2)
        self.idle = False
        self.polls = 0

    def handler(self, write: Callable[[DataFrame, int], object]):
        def handle(_clock: DataFrame, batch_id: int) -> None:
            if self.put != batch_id - 1:  # the first batch of a run; later ones know what the one before has put
                found = self.state.before(batch_id).agg(F.max("last")).first()[0]
                self.last = self.start if found is None else found
            found = None if self.idle or self.enough() else self.pages.next(self.load(), self.last)
            last = self.last
            if found is None:
                self.idle = self.idle or (self.draining and not self.enough())
            else:
                last, rows = found
                write(rows, batch_id)
            # Batches without a page put the id as well, for the state counts on one from every batch.
            self.state.put_row({"name": "all", "last": last}, batch_id)
            self.last, self.put = last, batch_id
            self.polls += found is not None

        return handle

    def enough(self) -> bool:
        return self.most is not None and self.polls >= self.most

    def start_query(self, write: Callable[[DataFrame, int], object], checkpoint: str, every: str = "10 seconds", draining: bool = False,
                    most: int | None = None) -> StreamingQuery:
        """Poll until stopped."""
        self.draining, self.most, self.idle, self.polls, self.put = draining, most, False, 0, None
        clock = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
        return clock.writeStream.foreachBatch(self.handler(write)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def drain(self, write: Callable[[DataFrame, int], object], checkpoint: str, most: int | None = None) -> int:
        """Poll until a page is empty, or ``most`` pages are written; the number of pages."""
        query = self.start_query(write, checkpoint, "0 seconds", draining=True, most=most)
        while not query.awaitTermination(0.05) and not self.idle and not self.enough():
            pass
        query.stop()
        return self.polls
