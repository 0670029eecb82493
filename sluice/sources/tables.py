"""SQL sources, incremental reads and polled event tables."""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.operators.predicates import where
from sluice.session import put_rows, scratch_path, shuffle_partitions


def jdbc_options(url: str, query: str, driver: str | None = None, user: str | None = None,
                 password: str | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options of a SQL query source.  The URL never becomes record metadata."""
    out = {"url": url, "query": query, "fetchsize": str(fetch_size)}
    out |= {k: v for k, v in {"driver": driver, "user": user, "password": password}.items() if v}
    return out


def split_read_options(column: str, low, high, partitions: int) -> dict[str, str]:
    """Options that let a table be read by many tasks at once (with ``dbtable``, not ``query``)."""
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(partitions)}


def sql_options(split: dict | None = None, **options) -> dict[str, str]:
    """Reader options of a SQL source; ``split`` (column, low, high, partitions) lets many tasks read the query."""
    out = jdbc_options(**options)
    if split:
        out |= {"dbtable": f"({out.pop('query')}) q"} | split_read_options(**split)
    return out


def bind(query: str, parameters: dict) -> str:
    """``query`` with ``:name`` replaced by literals: numbers as they are, text quoted, None as NULL."""
    def literal(hit) -> str:
        if hit[1] is None:
            return hit[0]  # quoted text stays as it is
        value = parameters[hit[1]]
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|(?<![:\w]):([A-Za-z_]\w*)", literal, query)


def read_sql(spark: SparkSession, query: str, parameters: dict | None = None, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**sql_options(query=bind(query, parameters or {}), **options)).load()


def decode_bytes(df: DataFrame) -> DataFrame:
    """Binary columns as text, as a SQL source delivers them."""
    binary = [f.name for f in df.schema.fields if f.dataType.typeName() == "binary"]
    return df.withColumns({n: F.col(n).cast("string") for n in binary}) if binary else df


def incremental(df: DataFrame, column: str, last=None) -> DataFrame:
    """Rows after the saved high-water mark; all rows when none is saved."""
    return df if last is None else df.filter(F.col(column) > F.lit(last))


def high_water_mark(df: DataFrame, column: str, last=None):
    """The mark to save after a read."""
    top = df.agg(F.max(column)).first()[0]
    return last if top is None else top


class MarkStore:
    """Saved marks by key, in a parquet table; the newest row of a key counts."""

    SCHEMA = "state_key string, mark string, saved_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(path)

    def get(self, key: str) -> str | None:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col("state_key") == key)
        return rows.agg(F.max_by("mark", "saved_at")).first()[0]

    def put(self, key: str, mark) -> None:
        row = {"state_key": [key], "mark": [str(mark)], "saved_at": pa.array([datetime.now(timezone.utc)], pa.timestamp("us", "UTC"))}
        put_rows(self.spark, f"{self.path.rstrip('/')}/mark-{uuid.uuid4().hex}.parquet", pa.table(row))


# Ranges of ids whose rows are counted in one pass when the end of a page is looked for.
BINS = 4096


def page_end(rows: DataFrame, last: int, id_column: str, size: int) -> int | None:
    """The id that ends the next page of ``size`` rows after ``last``; None when there are no more rows.

    Rows are counted by ranges of ids, then by smaller ranges within the one where the page ends.  Nothing is sorted, and a pass brings
    at most ``BINS`` counts to the driver.  Rows with the same id stay together.
    """
    later = rows.filter(F.col(id_column) > F.lit(last))
    low, high = last, later.agg(F.max(id_column)).first()[0]
    if high is None:
        return None
    wanted = size
    while True:
        width = -(-(high - low) // BINS)
        place = F.expr(f"(`{id_column}` - {low} - 1) div {width}")
        counts = later.filter(F.col(id_column).between(low + 1, high)).groupBy(place.alias("at")).count().collect()
        for at, n in sorted(map(tuple, counts)):
            if n >= wanted:
                low, high = low + at * width, min(high, low + (at + 1) * width)
                break
            wanted -= n
        else:
            return high  # the last page
        if width == 1:
            return high


def page(table: DataFrame, last: int, end: int, id_column: str = "id", columns: list[str] | None = None, condition=None,
         order_by: str | None = None) -> DataFrame:
    """Rows after ``last`` up to ``end``, in the order of ``order_by``."""
    rows = new_events(table, last, id_column, columns, condition).filter(F.col(id_column) <= F.lit(end))
    return rows.orderBy(*dict.fromkeys([order_by or id_column, id_column]))


# Pages that are cut in one pass, and rows they may hold together, which is also what one task may sort.
PAGES_AHEAD, ROWS_AHEAD = 1024, 1 << 22
# Rows below which storing pages is not shared between tasks.
ROWS_PER_TASK = 1 << 16
PAGE, FIRST = "_poll_page", "_poll_first"


def _cut(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(end, rows) of every page from (id, rows) in the order of ids; the last page may be short."""
        found = pa.Table.from_batches(batches)
        ids, upto = found.column(0).to_numpy(), np.cumsum(found.column(1).to_numpy())
        ends, rows, before = [], [], 0
        while len(ids) and before < upto[-1]:
            at = min(int(np.searchsorted(upto, before + size)), len(ids) - 1)
            ends.append(int(ids[at]))
            rows.append(int(upto[at]) - before)
            before = int(upto[at])
        yield pa.record_batch([pa.array(ends, pa.int64()), pa.array(rows, pa.int64())], names=["end", "rows"])

    return cut


def _page_number(ids: Column, ends: list[int]) -> Column:
    upper = np.array(ends)
    return F.arrow_udf(lambda a: pa.array(np.searchsorted(upper, a.to_numpy()), pa.int32()), "int")(ids)


class Pages:
    """Pages of ``size`` rows of an event table, one after the other.

    The ends of the next pages, up to ``PAGES_AHEAD``, are found in one pass over their ids, and their rows are stored in a second one, each page by
    itself and in its order.  Handing out a page then reads nothing but that page.  Only tables of files are read ahead, and pages
    larger than ``ROWS_AHEAD`` never are: they are found and sorted one at a time.

    The table may grow.  Where its files have changed since it was read ahead, the rows up to the end of what is stored are counted; unless there are
    as many as are left, the pages are cut again.
    """

    def __init__(self, id_column: str = "id", columns: list[str] | None = None, condition=None, order_by: str | None = None, size: int = 1000):
        self.how = (id_column, columns, condition, order_by)
        self.size = size
        self.waiting: deque[tuple[int, int, int | None]] = deque()  # end, rows, number of a stored page
        self.last = self.files = self.stored = None

    def next(self, table: DataFrame, last: int) -> tuple[int, DataFrame] | None:
        """The id that ends the page after ``last``, and its rows; None when there are no more."""
        files = self._files(table)
        if not self.waiting or self.last != last or (files != self.files and not self._whole(table, last)):
            self._read_ahead(table, last, bool(files))
        self.files = files
        if not self.waiting:
            return None
        end, _, number = self.waiting.popleft()
        self.last = end
        if number is None:
            return end, page(table, last, end, *self.how)
        # A page is one task's work; its rows stand in this order already, but in how many pieces they are read is Spark's choice.
        rows = self.stored.filter(F.col(PAGE) == number).coalesce(1).sortWithinPartitions(FIRST, f"`{self.how[0]}`")
        return end, rows.drop(PAGE, FIRST)

    def _files(self, table: DataFrame) -> str:
        """Names, sizes and times of the files of the table; empty if it is not made of files."""
        spark, out = table.sparkSession, []
        for folder in sorted({f.rpartition("/")[0] for f in table.inputFiles()}):
            place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            held = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
            out += [re.sub(r"access_time=\d+", "", status.toString()) for status in held]
        return "".join(out)

    def _rows(self, table: DataFrame, last: int, end: int) -> DataFrame:
        id_column, _, condition, _ = self.how
        return where(table.filter((F.col(id_column) > F.lit(last)) & (F.col(id_column) <= F.lit(end))), condition)

    def _whole(self, table: DataFrame, last: int) -> bool:
        return self._rows(table, last, self.waiting[-1][0]).count() == sum(n for _, n, _ in self.waiting)

    def _read_ahead(self, table: DataFrame, last: int, files: bool) -> None:
        id_column, columns, condition, order_by = self.how
        self.waiting.clear()
        ahead = min(PAGES_AHEAD, ROWS_AHEAD // self.size) if files else 0
        wanted = self.size * max(ahead, 1)
        end = page_end(where(table, condition), last, id_column, wanted)
        if end is None:
            return
        if ahead < 2:
            self.waiting.append((end, 0, None))
            return
        found = self._rows(table, last, end)
        counts = found.groupBy(F.col(id_column).cast("bigint").alias("id")).count()
        cut = [tuple(r) for r in counts.repartition(1).sortWithinPartitions("id").mapInArrow(_cut(self.size), "end long, rows long").collect()]
        if len(cut) > 1 and cut[-1][1] < self.size and sum(n for _, n in cut) >= wanted:
            cut.pop()  # more rows of this page may follow behind those that were read
        if len(cut) == 1:
            self.waiting.append((*cut[0], None))
            return
        ends, large = [e for e, _ in cut], [i for i, (_, n) in enumerate(cut) if n > ROWS_AHEAD]
        names = [*dict.fromkeys([*columns, id_column])] if columns else table.columns
        rows = found.filter(F.col(id_column) <= F.lit(ends[-1])).select(
            _page_number(F.col(id_column).cast("bigint"), ends).alias(PAGE), F.col(order_by or id_column).alias(FIRST), *[F.col(f"`{n}`") for n in names])
        path = scratch_path(table.sparkSession, "pages")
        dealt = rows.filter(~F.col(PAGE).isin(large)) if large else rows
        tasks = min(len(cut), -(-sum(n for _, n in cut) // ROWS_PER_TASK), shuffle_partitions(table.sparkSession))
        (dealt.repartition(tasks, PAGE).sortWithinPartitions(PAGE, FIRST, f"`{id_column}`")
         .write.partitionBy(PAGE).parquet(path))
        self.stored = table.sparkSession.read.schema(rows.schema).parquet(path)  # the folders are listed once
        self.waiting.extend((e, n, None if i in large else i) for i, (e, n) in enumerate(cut))


def poll(table: DataFrame, last, id_column: str = "id", columns: list[str] | None = None, condition=None,
         order_by: str | None = None, batch_size: int = 1000) -> DataFrame:
    """One poll of an event table: the next ``batch_size`` rows after ``last`` by id, in the order of ``order_by``.

    Pages are cut by id (whole numbers) whatever the order within them, so that the next poll begins where this one ended; they are read as a
    range of ids, which any number of tasks share.  The id column is always part of the result.
    """
    end = page_end(where(table, condition), last, id_column, batch_size)
    return page(table, last, last if end is None else end, id_column, columns, condition, order_by)


def new_events(table: DataFrame, last=0, id_column: str = "id", columns: list[str] | None = None, condition=None) -> DataFrame:
    """All rows of an event table after ``last``: what polling until nothing is left returns."""
    rows = where(table.filter(F.col(id_column) > F.lit(last)), condition)
    return rows.select(*dict.fromkeys([*columns, id_column])) if columns else rows


def poll_all(table: DataFrame, handle: Callable[[DataFrame], None], marks: MarkStore, key: str, start=0,
             **options) -> Iterator[int]:
    """Poll until nothing is left; the mark is saved after ``handle`` has stored a batch.

    Yields the mark after each batch.  A restart goes on from the saved mark.
    """
    pages = Pages(size=options.pop("batch_size", 1000), **options)
    saved = marks.get(key)
    last = start if saved is None else type(start)(saved)
    while (found := pages.next(table, last)) is not None:
        last, rows = found
        handle(rows)
        marks.put(key, last)
        yield last
