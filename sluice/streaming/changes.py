"""A table kept up to date from a stream of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice.operators.blocks import first_rows
from sluice.operators.changes import DeletePolicy, apply_changes, is_delete
from sluice.streaming.state import KeyedState


def essential(log: DataFrame, keys: list[str], order: list[str], policy: DeletePolicy, envelope: list[str] = ()) -> DataFrame:
    """The events of a log that its table depends on: of each key the latest one, and the latest that is not a delete.

    Applying these gives what applying the whole log gives, and they can be reduced again together with later events.
    """
    flagged = log.withColumn("_gone", is_delete(log, policy, keys, envelope))
    newest = [F.desc(o) for o in order]
    last = first_rows(flagged, keys, newest)
    body = first_rows(flagged.filter(~F.col("_gone")), keys, newest)
    # A key's latest event is often also its latest body: then one row is enough.
    both = last.filter("_gone").unionByName(body)
    return both.drop("_gone")


class ChangeTable:
    """State for ``foreachBatch``: the essential events of every key, kept as a compacted table.

    A batch stores its own essential events and rewrites one class of keys, see ``KeyedState``; a retried batch replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], policy: DeletePolicy,
                 ts: str | None = None, envelope: list[str] = (), classes: int = 4):
        self.rule = (keys, order, policy)
        self.ts, self.envelope = ts, list(envelope)
        self.state = KeyedState(spark, path, schema, keys, lambda rows: essential(rows, *self.rule, self.envelope), classes)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        self.state.put(batch, batch_id)

    def current(self) -> DataFrame:
        """The table after the last batch."""
        keys, order, policy = self.rule
        return apply_changes(self.state.current(), keys, order, policy, self.ts, self.envelope)
