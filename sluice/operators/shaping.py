"""Stages that change the fields of a record."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions.scalars import RFC3339, date_pattern, json_object, now_rfc3339, template
from sluice.functions.values import TypedRecord, text_of
from sluice.operators.predicates import where
from sluice.operators.routing import sample


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def select(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keep the listed fields; absent ones are ignored."""
    return df.select(*[_c(f) for f in fields if f in df.columns])


def exclude(df: DataFrame, fields: list[str]) -> DataFrame:
    """Drop the listed fields."""
    return df.drop(*fields)


_LINE = re.compile(r"\s*([^\s=#][^\s=]*)\s*=\s*(?:\.([^\s'\"]+)|'([^']*)'|\"([^\"]*)\")\s*")


def transform(df: DataFrame, lines: str | list[str]) -> DataFrame:
    """``new = .old`` and ``new = 'text'`` lines; every right side reads the incoming record."""
    lines = lines.splitlines() if isinstance(lines, str) else lines
    new: dict[str, Column] = {}
    for line in lines:
        hit = _LINE.fullmatch(line)
        if not hit or line.lstrip().startswith("#"):
            continue
        name, source, single, double = hit.groups()
        if source is None:
            new[name] = F.lit(single if single is not None else double)
        elif source in df.columns:
            new[name] = _c(source)
    return df.withColumns(new) if new else df


def remap(df: DataFrame, mappings: dict[str, str] | None = None, message: str = "message",
          message_schema: str | None = None, processed_at: Column | None = None) -> DataFrame:
    """Add ``processed_at``, overlay the fields of a JSON message, then copy ``new <- old``.

    ``message_schema`` (DDL) names the message fields that become columns.  Copies read the
    incoming record and win over message fields, which win over ``processed_at``.
    """
    new: dict[str, Column] = {"processed_at": processed_at if processed_at is not None else now_rfc3339()}
    if message_schema and message in df.columns:
        df = df.withColumn("_parsed", json_object(_c(message)))
        parsed = _c("_parsed")
        for field in T.StructType.fromDDL(message_schema).fields:
            value = F.try_variant_get(parsed, f"$['{field.name}']", field.dataType.simpleString())
            new[field.name] = F.coalesce(value, _c(field.name)) if field.name in df.columns else value
    for target, source in (mappings or {}).items():
        if source in df.columns:
            new[target] = _c(source)
    return df.withColumns(new).drop("_parsed")


def rename(df: DataFrame, mappings: dict[str, str], drop_unmapped: bool = False) -> DataFrame:
    """Rename ``source -> target``; with ``drop_unmapped`` keep only the renamed fields."""
    known = {s: t for s, t in mappings.items() if s in df.columns}
    if drop_unmapped:
        return df.select(*[_c(s).alias(t) for s, t in known.items()])
    return df.withColumnsRenamed(known)


def enrich(df: DataFrame, fields: dict | None = None, lookup_table: str | None = None) -> DataFrame:
    """Set constant fields, and ``enriched_from`` when a lookup table is named."""
    new = {k: F.lit(v) for k, v in (fields or {}).items()}
    if lookup_table:
        new["enriched_from"] = F.lit(lookup_table)
    return df.withColumns(new) if new else df


def merge(df: DataFrame, sources: list[str], target: str, delimiter: str = " ",
          pattern: str | None = None) -> DataFrame:
    """Join several fields with a delimiter, or fill a ``{{field}}`` template."""
    record = TypedRecord(df.schema)
    if pattern:
        return df.withColumn(target, template(pattern, lambda n: record.field(n).text))
    return df.withColumn(target, F.concat_ws(delimiter, *[record.field(s).text for s in sources]))


def split(df: DataFrame, source: str, pattern: str, targets: list[str], keep_original: bool = True) -> DataFrame:
    """Regex groups to fields, in group order; NULL where the pattern does not match."""
    hit = _c(source).rlike(pattern)
    new = {t: F.when(hit, F.regexp_extract(_c(source), pattern, i)) for i, t in enumerate(targets, 1)}
    out = df.withColumns(new)
    return out if keep_original or source in targets else out.drop(source)


def mask(column: Column, char: str = "*", keep_first: int = 0, keep_last: int = 0) -> Column:
    """Cover the middle of a text; a text no longer than the kept ends is covered whole."""
    length = F.char_length(column)
    hidden = length - F.lit(keep_first + keep_last)
    covered = F.concat(
        F.left(column, F.lit(keep_first)), F.repeat(F.lit(char), hidden.cast("int")),
        F.right(column, F.lit(keep_last)),
    )
    return F.when(hidden > 0, covered).otherwise(F.repeat(F.lit(char), length))


def encrypt(df: DataFrame, fields: list[str], method: str = "sha256", key_env: str | None = None,
            mask_char: str = "*", keep_first: int = 0, keep_last: int = 0) -> DataFrame:
    """sha256, sha512, aes256 (base64 of AES-GCM, key from an environment variable) or mask."""
    record = TypedRecord(df.schema)

    def cover(text: Column) -> Column:
        if method in ("sha256", "sha512"):
            return F.sha2(text, int(method[3:]))
        if method == "aes256":
            return F.base64(F.aes_encrypt(text, F.lit(_aes_key(key_env)), F.lit("GCM")))
        if method == "mask":
            return mask(text, mask_char, keep_first, keep_last)
        raise ValueError(f"unknown method {method!r}")

    return df.withColumns({f: cover(record.field(f).text) for f in fields if f in df.columns})


def decrypt(column: Column, key_env: str) -> Column:
    """Text of a field written by ``encrypt(method="aes256")``."""
    return F.aes_decrypt(F.unbase64(column), F.lit(_aes_key(key_env)), F.lit("GCM")).cast("string")


def _aes_key(key_env: str | None) -> bytes:
    key = os.environ.get(key_env or "", "").encode()
    if len(key) != 32:
        raise ValueError(f"environment variable {key_env!r} must hold a key of 32 bytes")
    return key


def default(df: DataFrame, defaults: dict, only_null: bool = True) -> DataFrame:
    """Fill NULL (and, unless ``only_null``, empty) fields; absent fields are added."""
    new = {}
    for name, value in defaults.items():
        if name not in df.columns:
            new[name] = F.lit(value)
            continue
        empty = _c(name).isNull()
        if not only_null and isinstance(df.schema[name].dataType, T.StringType):
            empty = empty | (_c(name) == "")
        new[name] = F.when(empty, F.lit(value)).otherwise(_c(name))
    return df.withColumns(new)


def _converted(column: Column, dtype: T.DataType, target: str, date_format: str | None) -> Column:
    text = isinstance(dtype, T.StringType)
    if target == "int":
        if text or isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            return F.coalesce(column.try_cast("bigint"), column.try_cast("double").try_cast("bigint"))
        return column.try_cast("bigint")
    if target == "float":
        return column.try_cast("double")
    if target == "string":
        return text_of(column, dtype)
    if target == "bool":
        return column.try_cast("boolean")
    if target == "date":
        if date_format:
            return F.try_to_timestamp(column.cast("string"), F.lit(date_pattern(date_format)))
        return column.try_cast("timestamp")
    raise ValueError(f"unknown type {target!r}")


def cast(df: DataFrame, casts: dict[str, str], date_format: str | None = None, on_error: str = "null") -> DataFrame:
    """Convert fields.  A value that does not convert becomes NULL, drops its record, or is
    kept, in which case the column stays text."""
    if on_error not in ("null", "drop", "keep"):
        raise ValueError(f"unknown error action {on_error!r}")
    new, failed = {}, F.lit(False)
    for name, target in casts.items():
        if name not in df.columns:
            continue
        dtype = df.schema[name].dataType
        value = _converted(_c(name), dtype, target, date_format)
        failed = failed | (_c(name).isNotNull() & value.isNull())
        if on_error == "keep":
            printed = F.date_format(value, RFC3339) if target == "date" else value.cast("string")
            value = F.coalesce(printed, text_of(_c(name), dtype))
        new[name] = value
    if on_error == "drop":
        df = df.filter(~failed)
    return df.withColumns(new) if new else df


def timestamp(df: DataFrame, action: str, target: str, source: str | None = None, timezone: str = "UTC",
              input_format: str | None = None, output_format: str | None = None,
              now: Column | None = None) -> DataFrame:
    """``add`` the current time, ``convert`` to a time zone, or ``format`` as text."""
    if action == "add":
        return df.withColumn(target, now if now is not None else F.current_timestamp())
    column = _c(source)
    if isinstance(df.schema[source].dataType, T.StringType):
        column = F.try_to_timestamp(column, F.lit(date_pattern(input_format))) if input_format \
            else column.try_cast("timestamp")
    if action == "convert":
        return df.withColumn(target, F.from_utc_timestamp(column, timezone))
    if action == "format":
        return df.withColumn(target, F.date_format(column, date_pattern(output_format or RFC3339)))
    raise ValueError(f"unknown action {action!r}")


def passthrough(df: DataFrame) -> DataFrame:
    return df


def json_parse(df: DataFrame, source: str = "message", target: str = "rec") -> DataFrame:
    """Parse a JSON text field into a VARIANT record; NULL when it does not parse."""
    return df.withColumn(target, F.try_parse_json(_c(source)))


def partition_keys(df: DataFrame, ts: str) -> DataFrame:
    """Add ``_partition_date`` and ``_partition_hour``."""
    return df.withColumns({
        "_partition_date": F.date_format(_c(ts), "yyyy-MM-dd"),
        "_partition_hour": F.date_format(_c(ts), "HH"),
    })


def derive(df: DataFrame, target: str, cases: list[tuple], otherwise=None) -> DataFrame:
    """First value whose filter passes, else ``otherwise``."""
    from sluice.operators.predicates import passes

    value = F.lit(otherwise)
    for spec, result in reversed(cases):
        value = F.when(passes(df, spec), F.lit(result)).otherwise(value)
    return df.withColumn(target, value)


def step(df: DataFrame, transform_lines=None, filter_spec=None, sample_rate: float = 0,
         select_fields: list[str] | None = None, exclude_fields: list[str] | None = None,
         seed: int = 0) -> DataFrame:
    """One step: transform, filter, sample, select, exclude, always in this order."""
    if transform_lines:
        df = transform(df, transform_lines)
    if filter_spec:
        df = where(df, filter_spec)
    if sample_rate:
        df = sample(df, sample_rate, seed)
    if select_fields:
        df = select(df, select_fields)
    if exclude_fields:
        df = exclude(df, exclude_fields)
    return df
