"""Keyed state of ``foreachBatch`` operators, kept as a compacted table.

Rows of a micro-batch are written as its delta, dealt into ``classes`` by a hash of the key.  Each batch also rewrites one class, in turn:
that class's last snapshot and the deltas behind it become its next snapshot, with one row per key, or however many the table's
``merge`` leaves.  What a batch reads is therefore the merged state and the deltas of fewer than ``classes`` batches, however many batches there
were, and what it rewrites is one class.  Which files count follows from the batch number alone, so there is no list to keep, and a batch that
is retried replaces what it wrote.  Files that neither this batch nor its retry needs are deleted.

The state belongs to one streaming query, told by its id, which lasts as long as its checkpoint.  A query with another id that is given the same
path starts from what its predecessor left and keeps files of its own; it never reads or overwrites its predecessor's batch numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sluice.session import put_rows

CLASS = "_class"


class KeyedState:
    """``merge`` reduces rows (``schema``) to those that count; it may be applied again to what it returned together with later rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], merge: Callable[[DataFrame], DataFrame],
                 classes: int = 4):
        self.spark, self.path, self.keys, self.merge, self.classes = spark, path.rstrip("/"), keys, merge, classes
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.home: str | None = None
        self.last = -1
        self.alone: int | None = None  # class of the only key

    # -- files -------------------------------------------------------------------------

    def _folder(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        system, place = self._folder(path)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def _drop(self, path: str) -> None:
        system, place = self._folder(path)
        if system.exists(place):
            system.delete(place, True)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # -- which query ------------------------------------------------------------------

    def _enter(self, batch_id: int) -> None:
        """Find this query's folder; a new query's begins with what the last one's holds."""
        if self.home is not None:
            return
        owner = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        names = self._names(self.path)  # one per query that ever used the path
        own = [n for n in names if n.endswith(f"={owner}")]
        if own:
            self.home = f"{self.path}/{own[0]}"
        else:
            self.home = f"{self.path}/query-{len(names):06d}={owner}"
            if names:
                before = KeyedState(self.spark, self.path, self.schema, self.keys, self.merge, self.classes)
                before.home = f"{self.path}/{names[-1]}"
                self._classed(self.merge(self._read(before._left()))).write.mode("overwrite").partitionBy(CLASS).parquet(f"{self.home}/base")
        self.based = "base" in self._names(self.home)
        self.last = max([self.last, *map(int, self._names(f"{self.home}/snapshots"))])

    def _left(self) -> list[str]:
        """All files of a query that has ended: its newest snapshots, and deltas behind them.  A batch is over once its snapshot is there."""
        self.based = "base" in self._names(self.home)
        done = [int(n) for n in self._names(f"{self.home}/snapshots")]
        return self._paths(max(done, default=-1) + 1)

    # -- state -------------------------------------------------------------------------

    def _classed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(CLASS, F.pmod(F.xxhash64(*self.keys), F.lit(self.classes)).cast("int"))

    def _snapshot(self, of: int, batch_id: int) -> int:
        """The last batch before this one that rewrote class ``of``; negative if there was none."""
        return batch_id - 1 - (batch_id - 1 - of) % self.classes

    def _paths(self, batch_id: int, of: int | None = None) -> list[str]:
        """Files that hold the state before a batch, of one class or of all."""
        found = []
        for c in range(self.classes) if of is None else [of]:
            at = self._snapshot(c, batch_id)
            if at >= 0:
                found.append(f"{self.home}/snapshots/{at}")
            elif self.based:
                found.append(f"{self.home}/base/{CLASS}={c}")
            found += [f"{self.home}/deltas/batch={b}/{CLASS}={c}" for b in range(max(at + 1, 0), batch_id)]
        return [p for p in found if self._exists(p)]

    def _exists(self, path: str) -> bool:
        system, place = self._folder(path)
        return system.exists(place)

    def before(self, batch_id: int) -> DataFrame:
        """The merged state that a batch starts from."""
        self._enter(batch_id)
        return self.merge(self._read(self._paths(batch_id)))

    def current(self) -> DataFrame:
        """The merged state after the last batch that was put, by the last query that used the path."""
        if self.home is None:
            names = self._names(self.path)
            if not names:
                return self.merge(self._read([]))
            self.home = f"{self.path}/{names[-1]}"
            paths, self.home = self._left(), None
            return self.merge(self._read(paths))
        return self.merge(self._read(self._paths(self.last + 1)))

    def files(self, batch_id: int) -> list[str]:
        """Folders that a batch reads."""
        self._enter(batch_id)
        return self._paths(batch_id)

    def put_row(self, row: dict, batch_id: int) -> None:
        """``put`` for a state with one key, of which ``row`` is then all that counts.  The driver writes it, without a job."""
        self._enter(batch_id)
        if self.alone is None:
            self.alone = self._classed(self.spark.createDataFrame([tuple(row[n] for n in self.schema.names)], self.schema)).first()[CLASS]
        rows = pa.Table.from_pylist([row], to_arrow_schema(self.schema))
        for folder, part in [(f"{self.home}/deltas/batch={batch_id}/{CLASS}={self.alone}", rows),
                             (f"{self.home}/snapshots/{batch_id}", rows.slice(0, int(batch_id % self.classes == self.alone)))]:
            self._drop(folder)
            put_rows(self.spark, f"{folder}/row.parquet", part)
        self._put(batch_id)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch's rows (merged among themselves), and rewrite the class whose turn it is."""
        self._enter(batch_id)
        (self._classed(self.merge(rows.select(*self.schema.names))).write.mode("overwrite").partitionBy(CLASS)
         .parquet(f"{self.home}/deltas/batch={batch_id}"))
        of = batch_id % self.classes
        paths = [*self._paths(batch_id, of), *[p for p in [f"{self.home}/deltas/batch={batch_id}/{CLASS}={of}"] if self._exists(p)]]
        self.merge(self._read(paths)).write.mode("overwrite").parquet(f"{self.home}/snapshots/{batch_id}")
        self._put(batch_id)

    def _put(self, batch_id: int) -> None:
        self.last = max(self.last, batch_id)
        # A retry of this batch needs the state before it: snapshots and deltas of the last ``classes`` batches.
        self._drop(f"{self.home}/snapshots/{batch_id - self.classes - 1}")
        self._drop(f"{self.home}/deltas/batch={batch_id - self.classes - 1}")
