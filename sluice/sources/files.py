"""File sources: JSON, CSV, lines, parquet, multi-line logs, and files as a stream."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice.functions.scalars import json_object
from sluice.operators.blocks import running_total
from sluice.sources.messages import record_fields


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_json_array(spark: SparkSession, paths, schema: str | T.StructType | None = None) -> DataFrame:
    """Files that hold one JSON array of objects; a malformed file fails the read."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(_paths(paths))


def read_ndjson(spark: SparkSession, paths, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; lines that are not one are skipped, whatever columns are read.

    A field that does not have its type is NULL and costs the record nothing.
    """
    return record_fields(read_json_records(spark, paths), schema)


def read_json_records(spark: SparkSession, paths) -> DataFrame:
    """One JSON object per line as a schemaless VARIANT ``rec``; other lines are skipped."""
    return spark.read.text(_paths(paths)).select(json_object(F.col("value")).alias("rec")).filter(F.col("rec").isNotNull())


def read_json(spark: SparkSession, paths, schema: str | T.StructType | None = None) -> DataFrame:
    """Files that each hold one JSON array, or one object per line: a file's first character that is not blank decides.

    Objects come as VARIANT ``rec``, or as the columns of ``schema``.  An array that does not parse fails the read.  An array
    cannot be split, so such a file is one task's work; files of lines are split as usual.
    """
    lines = spark.read.text(_paths(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        F.substring(F.regexp_replace("value", r"^[\s\uFEFF]+", ""), 1, 1).alias("first")).filter("first <> ''")
    # A row per file, as many as the driver lists anyway.
    kinds = {r["file"]: r["first"] for r in lines.groupBy("file").agg(F.min_by("first", "at").alias("first")).collect()}
    arrays = sorted(f for f, first in kinds.items() if first == "[")
    plain = sorted(f for f, first in kinds.items() if first != "[")
    frames = []
    if arrays:
        whole = spark.read.text(arrays, wholetext=True)
        items = F.try_variant_get(F.parse_json("value"), "$", "array<variant>")
        fields = F.try_variant_get("rec", "$", "map<string,variant>")
        frames.append(whole.select(F.explode(items).alias("rec")).filter(fields.isNotNull()))
    if plain or not arrays:
        frames.append(read_json_records(spark, plain) if plain else spark.createDataFrame([], "line string").select(F.try_parse_json("line").alias("rec")))
    records = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return record_fields(records, schema) if schema else records


def read_csv(spark: SparkSession, paths, delimiter: str = ",") -> DataFrame:
    """First row is the header, every value is text."""
    return spark.read.option("header", True).option("sep", delimiter).option("inferSchema", False).csv(_paths(paths))


def read_parquet(spark: SparkSession, paths) -> DataFrame:
    return spark.read.parquet(*_paths(paths))


def read_files(spark: SparkSession, fmt: str, paths, **options) -> DataFrame:
    """Several paths or globs in one format; a path that matches nothing is an error."""
    return spark.read.format(fmt).options(**options).load(_paths(paths))


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """``file``, ``line_no`` (1-based per file) and ``line``.

    A file is split over tasks.  Within a split, lines keep their order, so a line's number is
    its place in the split plus the lines of the file's earlier splits.  Only the per-split
    counts are shuffled and sorted, never the lines.
    """
    raw = spark.read.text(_paths(paths)).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    from pyspark.sql import Window

    splits = raw.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        raw.join(placed, ["file", "_start"])
        .select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")
    )


def group_lines(lines: DataFrame, start_pattern: str, split: bool | None = None) -> DataFrame:
    """Join lines to the entry they continue: ``file``, ``line_no`` of the entry's first line, ``entry``.

    A line that matches ``start_pattern`` opens an entry.  Lines before the first opening one
    form an entry of their own.
    """
    opens = F.col("line").rlike(start_pattern).cast("int")
    marked = running_total(lines, ["file"], [F.col("line_no")], opens, "_entry", split)
    part = F.struct("line_no", "line")
    return (
        marked.groupBy("file", "_entry")
        .agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(part)).alias("_parts"))
        .select("file", "line_no", F.array_join(F.col("_parts.line"), "\n").alias("entry"))
    )


def stream_files(spark: SparkSession, fmt: str, path: str, schema, include: str | None = None,
                 from_beginning: bool = True, max_files: int | None = None, exclude: str | None = None) -> DataFrame:
    """New files of a folder as a stream.  ``from_beginning=False`` leaves out the files that are there before the stream is
    defined; ``exclude`` is a pattern (``*`` and ``?``) of file names to leave out."""
    r = spark.readStream.format(fmt).schema(schema)
    if include:
        r = r.option("pathGlobFilter", include)
    if not from_beginning:
        r = r.option("modifiedAfter", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    rows = r.load(path)
    if exclude:
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in exclude)
        rows = rows.filter(~name.rlike(f"^{pattern}$"))
    return rows


def with_metadata(df: DataFrame, source: str, origin=None, offset=None, ts=None) -> DataFrame:
    """Add ``_meta``: source, origin, offset, timestamp (ms).  Files give their path and split start."""
    as_text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return df.withColumn("_meta", F.struct(
        F.lit(source).alias("source"), as_text(origin).alias("origin"), as_text(offset).alias("offset"),
        (F.lit(None).cast("bigint") if ts is None else F.unix_millis(ts.cast("timestamp"))).alias("timestamp"),
    ))
