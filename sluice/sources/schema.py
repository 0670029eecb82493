"""Reader schemas from field lists, and inferred ones."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Field types of a source schema.
TYPES = {
    "string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(),
    "bool": T.BooleanType(), "datetime": T.TimestampType(), "json": T.VariantType(),
}


def struct_from_fields(fields: list[dict]) -> T.StructType:
    """``[{"name", "type", "required"}]`` as a reader schema; ``required`` means not nullable."""
    return T.StructType([T.StructField(f["name"], TYPES[f["type"]], not f.get("required", False)) for f in fields])


def struct_from_json_schema(document: dict) -> T.StructType:
    """Top-level properties of a JSON Schema as a reader schema; nested ones stay VARIANT."""
    names = {"string": "string", "number": "float", "integer": "int", "boolean": "bool"}
    required = document.get("required", [])
    return struct_from_fields([
        {"name": n, "type": names.get(p.get("type"), "json"), "required": n in required}
        for n, p in document.get("properties", {}).items()
    ])


# Plain Avro types, and what a logical type makes of them.
AVRO_TYPES = {
    "null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(),
}
AVRO_LOGICAL = {
    ("int", "date"): T.DateType(), ("long", "timestamp-millis"): T.TimestampType(), ("long", "timestamp-micros"): T.TimestampType(),
    ("long", "local-timestamp-millis"): T.TimestampNTZType(), ("long", "local-timestamp-micros"): T.TimestampNTZType(),
}


class _Avro:
    """Avro types as Spark types; named types can be used again by their name."""

    def __init__(self):
        self.named: dict[str, T.DataType] = {}

    def read(self, kind, space: str = "") -> tuple[T.DataType, bool]:
        """The type, and whether it takes NULL."""
        if isinstance(kind, list):
            return self.union(kind, space)
        if isinstance(kind, str):
            found = AVRO_TYPES.get(kind) or self.named.get(kind) or self.named.get(f"{space}.{kind}")
            if found is None:
                raise ValueError(f"unknown Avro type {kind!r}")
            return found, kind == "null"
        base = kind.get("type")
        if base == "array":
            item, null = self.read(kind["items"], space)
            return T.ArrayType(item, null), False
        if base == "map":
            value, null = self.read(kind["values"], space)
            return T.MapType(T.StringType(), value, null), False
        if base in ("record", "enum", "fixed"):
            return self.name(kind, space), False
        if not isinstance(base, str) or base not in AVRO_TYPES:
            return self.read(base, space)
        if kind.get("logicalType") == "decimal":
            return T.DecimalType(kind["precision"], kind.get("scale", 0)), False
        return AVRO_LOGICAL.get((base, kind.get("logicalType")), AVRO_TYPES[base]), base == "null"

    def name(self, kind: dict, space: str) -> T.DataType:
        space = kind.get("namespace", space)
        full = kind["name"] if "." in kind["name"] or not space else f"{space}.{kind['name']}"
        if kind["type"] == "record":
            if full in self.named:
                raise ValueError(f"{full} is defined twice")
            fields = []
            for f in kind["fields"]:
                made, null = self.read(f["type"], full.rpartition(".")[0])
                fields.append(T.StructField(f["name"], made, null))
            out: T.DataType = T.StructType(fields)
        elif kind["type"] == "enum":
            out = T.StringType()
        else:
            out = T.DecimalType(kind["precision"], kind.get("scale", 0)) if kind.get("logicalType") == "decimal" else T.BinaryType()
        self.named[full] = out
        return out

    def union(self, kinds: list, space: str) -> tuple[T.DataType, bool]:
        """With null: a type that takes NULL.  Numbers of two widths: the wider.  Other mixtures: a struct with a field for each."""
        null = "null" in kinds
        made = [self.read(k, space)[0] for k in kinds if k != "null"]
        if len(made) == 1:
            return made[0], null
        if set(made) == {T.IntegerType(), T.LongType()}:
            return T.LongType(), null
        if set(made) == {T.FloatType(), T.DoubleType()}:
            return T.DoubleType(), null
        if not made:
            return T.NullType(), True
        return T.StructType([T.StructField(f"member{i}", m) for i, m in enumerate(made)]), null


def struct_from_avro(text: str) -> T.StructType:
    """An Avro record definition as a reader schema."""
    found, _ = _Avro().read(json.loads(text))
    if not isinstance(found, T.StructType):
        raise ValueError("the definition is not a record")
    return found


def source_schema(kind: str, definition: str | None = None, fields: list[dict] | None = None) -> T.StructType | None:
    """The reader schema that a source's definition names: ``json_schema``, ``avro``, a field list, or ``infer`` (None)."""
    if kind == "infer":
        return None
    if fields:
        return struct_from_fields(fields)
    if kind not in ("json_schema", "avro") or not definition:
        raise ValueError(f"a schema of type {kind!r} needs a definition")
    return struct_from_avro(definition) if kind == "avro" else struct_from_json_schema(json.loads(definition))


def inferred_json_schema(df: DataFrame, column: str) -> str:
    """One DDL type that fits every JSON text of a column; schemas are merged on the executors."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]


def structured(column: Column, fields: list[dict]) -> Column:
    """JSON text as a struct of the given fields."""
    return F.from_json(column, struct_from_fields(fields))


def reader(spark: SparkSession, schema: list[dict] | T.StructType | str | None = "infer"):
    """A reader with the schema applied, or one that infers it."""
    if schema is None or schema == "infer":
        return spark.read.option("inferSchema", True)
    return spark.read.schema(schema if isinstance(schema, T.StructType) else struct_from_fields(schema))
