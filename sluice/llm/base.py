"""What the corpus operators share: registration, packed keys and small byte helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ASCII white space, the only separator of words in most operators here.
BLANKS = b" \t\n\x0b\x0c\r"

# Stands for a NULL doc_id where ids are held in 64-bit arrays; it sorts before all others.
NO_ID = -(1 << 63)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL twin where SQL can say it."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes, which Python reads without decoding; NULL becomes empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))


def from_key(key: Column) -> Column:
    """Undo ``id_key``."""
    return F.when(key != F.lit(NO_ID), key)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library than glibc
    _TRIM = None


def give_back() -> None:
    """Return memory that earlier tasks of this worker have freed; workers are reused, and what they keep adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], n: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``n`` rows, so that few texts are Python objects at a time."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
    give_back()


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples."""
    for batch in slices(batches):
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


class Sender:
    """Collects rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_rows: int = 20_000, max_bytes: int = 16 << 20):
        self.schema, self.max_rows, self.max_bytes = schema, max_rows, max_bytes
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """True when the caller should send ``take()``."""
        self.waiting.append(row)
        self.held += size
        return len(self.waiting) >= self.max_rows or self.held >= self.max_bytes

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.waiting, strict=True)) if self.waiting else [()] * len(self.schema)
        self.waiting, self.held = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """One batch from numpy arrays or lists."""
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as compressed columns and go on from there; for large intermediate tables."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Size of the text column, an exact figure from one narrow pass."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


# Letters A-Z in lower case; other ASCII signs but a-z and 0-9 become blanks.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased runs of ASCII letters, digits and other alphabets' bytes, in lists of about ``size`` bytes of text."""
    if len(text) <= size:
        yield text.translate(TERMS).split()
        return
    plain = text.translate(TERMS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end
