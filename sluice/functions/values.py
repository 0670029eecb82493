"""How a record field is printed, read as a number and tested for presence.

Two record shapes share one interface.  ``TypedRecord`` wraps the columns of a DataFrame,
where a NULL cell stands for a missing key.  ``VariantRecord`` wraps one VARIANT column and
keeps a present JSON null apart from a missing key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
FRACTIONAL = (T.FloatType, T.DoubleType)


def literal_text(value) -> str:
    """Printed form of a literal: no trailing ``.0``, lower-case booleans, null as ''."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


def literal_number(value) -> float | int | None:
    """Numeric reading of a literal; booleans and unparsable strings have none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return value
    try:
        number = float(str(value).strip())
    except ValueError:
        return None
    return int(number) if number.is_integer() and abs(number) < 1e15 else number


def text_of(column: Column, dtype: T.DataType) -> Column:
    """Printed form of a typed column."""
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, FRACTIONAL):
        whole = (column == F.floor(column)) & (F.abs(column) < F.lit(1e15))
        return F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    if isinstance(dtype, T.BinaryType):
        return column.cast("string")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def number_of(column: Column, dtype: T.DataType) -> Column:
    """Numeric reading of a typed column; NULL where it has none."""
    if isinstance(dtype, NUMERIC):
        return column.cast("double")
    if isinstance(dtype, T.StringType):
        return F.trim(column).try_cast("double")
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class Field:
    """One field of a record, in the forms the operators need."""

    value: Column
    dtype: T.DataType
    present: Column
    null: Column
    variant: bool = False

    @property
    def text(self) -> Column:
        if self.variant:
            return _variant_text(self.value)
        return text_of(self.value, self.dtype)

    @property
    def number(self) -> Column:
        if self.variant:
            kind = F.schema_of_variant(self.value)
            readable = ~kind.isin("BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
            return F.when(readable, F.try_variant_get(self.value, "$", "double"))
        return number_of(self.value, self.dtype)

    @property
    def numeric(self) -> bool:
        return not self.variant and isinstance(self.dtype, NUMERIC)

    @property
    def string(self) -> bool:
        return not self.variant and isinstance(self.dtype, T.StringType)


def _variant_text(value: Column) -> Column:
    plain = F.try_variant_get(value, "$", "string")
    number = F.schema_of_variant(value).startswith("DECIMAL") & plain.contains(".")
    trimmed = F.regexp_replace(plain, r"\.?0+$", "")
    return F.when(F.is_variant_null(value), F.lit("")).when(number, trimmed).otherwise(plain)


def path_parts(path: str) -> list[str]:
    """Parts of a dotted path; empty parts (also a leading dot) are skipped."""
    return [part for part in path.split(".") if part]


class TypedRecord:
    """Fields of a DataFrame with a schema."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def field(self, path: str) -> Field:
        column, dtype = None, self.schema
        for part in path_parts(path):
            if not isinstance(dtype, T.StructType) or part not in dtype.names:
                absent = F.lit(None).cast("string")
                return Field(absent, T.StringType(), F.lit(False), F.lit(True))
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            dtype = dtype[part].dataType
        if isinstance(dtype, T.VariantType):
            return Field(column, dtype, column.isNotNull(),
                         column.isNull() | F.is_variant_null(column), variant=True)
        return Field(column, dtype, column.isNotNull(), column.isNull())


class VariantRecord:
    """Fields of one schemaless VARIANT column."""

    def __init__(self, column: str | Column = "rec"):
        self.column = F.col(column) if isinstance(column, str) else column

    def field(self, path: str) -> Field:
        value = F.try_variant_get(self.column, variant_path(path), "variant")
        return Field(value, T.VariantType(), value.isNotNull(),
                     value.isNull() | F.is_variant_null(value), variant=True)


def variant_path(path: str, indexes: bool = False) -> str:
    """``a.b`` as a variant path; with ``indexes`` an all-digit part selects an array item."""
    out = "$"
    for part in path_parts(path):
        out += f"[{part}]" if indexes and part.isdigit() else f"['{part}']"
    return out
