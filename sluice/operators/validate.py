"""Record validation: every rule is a Column, the errors of a record are one array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions.values import (
    NUMERIC, Field, TypedRecord, VariantRecord, literal_text, path_parts, variant_path,
)
from sluice.operators.predicates import java_regex

ERRORS = "_errors"
ERROR_TYPE = "array<struct<field:string,message:string>>"
FIELD_TYPES = ("string", "number", "integer", "boolean", "object", "array", "any")


def schema_from_dict(config: dict) -> dict:
    """Check and normalise a validation schema: ``{"fields": [...], "strict": bool}``."""
    return {"fields": [_field_from_dict(f) for f in config.get("fields", [])],
            "strict": bool(config.get("strict", False))}


def _field_from_dict(config: dict) -> dict:
    kind = config.get("type", "any")
    if kind not in FIELD_TYPES:
        raise ValueError(f"unknown field type {kind!r}")
    out = {k: v for k, v in config.items() if v is not None} | {"type": kind}
    if "items" in out:
        out["items"] = _field_from_dict(out["items"])
    if "properties" in out:
        out["properties"] = [_field_from_dict(p) for p in out["properties"]]
    return out


def schema_from_json_schema(document: dict) -> dict:
    """``type``, ``required`` and ``properties`` of a JSON Schema as a validation schema."""
    return {"fields": _json_schema_properties(document), "strict": document.get("additionalProperties") is False}


# JSON Schema keywords and the rule each one sets.
JSON_SCHEMA_RULES = {
    "minLength": "min_length", "maxLength": "max_length", "pattern": "pattern",
    "minimum": "min", "maximum": "max", "enum": "enum",
}


def _json_schema_properties(document: dict) -> list[dict]:
    fields = []
    properties = document.get("properties", {})
    required = document.get("required", [])
    for name in [*properties, *[r for r in required if r not in properties]]:
        rule = properties.get(name, {})
        field = {"name": name, "type": rule.get("type", "any"), "required": name in required}
        field |= {ours: rule[theirs] for theirs, ours in JSON_SCHEMA_RULES.items() if theirs in rule}
        if "properties" in rule:
            field["properties"] = _json_schema_properties(rule)
        if "items" in rule:
            field["items"] = {"name": "", "type": rule["items"].get("type", "any")}
        fields.append(field)
    return fields


def _as_field(value: Column, dtype: T.DataType) -> Field:
    if isinstance(dtype, T.VariantType):
        return Field(value, dtype, value.isNotNull(), value.isNull() | F.is_variant_null(value), variant=True)
    return Field(value, dtype, value.isNotNull(), value.isNull())


def _kind_ok(f: Field, kind: str) -> Column:
    """Does the value have this type?  Known from the schema for a typed field."""
    if f.variant:
        name = F.schema_of_variant(f.value)
        number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
        return {
            "any": F.lit(True), "string": name == "STRING", "boolean": name == "BOOLEAN", "number": number,
            "integer": number & (f.number == F.floor(f.number)),
            "array": name.startswith("ARRAY"), "object": name.startswith("OBJECT"),
        }[kind]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if kind == "integer" and isinstance(f.dtype, NUMERIC) and not isinstance(f.dtype, whole):
        return f.value == F.floor(f.value)
    return F.lit({
        "any": True,
        "string": isinstance(f.dtype, T.StringType),
        "number": isinstance(f.dtype, NUMERIC),
        "integer": isinstance(f.dtype, whole),
        "boolean": isinstance(f.dtype, T.BooleanType),
        "array": isinstance(f.dtype, T.ArrayType),
        "object": isinstance(f.dtype, T.StructType),
    }[kind])


def _kind_error(kind: str) -> str:
    return f"must be {'an' if kind[0] in 'aeiou' else 'a'} {kind}"


def value_error(f: Field, rule: dict) -> Column:
    """Message of the first broken rule of one value, NULL when none is broken."""
    kind = rule["type"]
    checks: list[tuple[Column, Column | str]] = [(~_kind_ok(f, kind), _kind_error(kind))]
    typed_as_asked = f.variant or _static_kind(f, kind)
    if kind == "string" and typed_as_asked:
        length = F.octet_length(f.text)
        if "min_length" in rule:
            checks.append((length < rule["min_length"], f"must have at least {int(rule['min_length'])} bytes"))
        if "max_length" in rule:
            checks.append((length > rule["max_length"], f"must have at most {int(rule['max_length'])} bytes"))
        if rule.get("pattern"):
            checks.append((~f.text.rlike(java_regex(rule["pattern"])), f"must match {rule['pattern']}"))
    elif kind in ("number", "integer") and typed_as_asked:
        if "min" in rule:
            checks.append((f.number < rule["min"], f"must be at least {literal_text(rule['min'])}"))
        if "max" in rule:
            checks.append((f.number > rule["max"], f"must be at most {literal_text(rule['max'])}"))
    elif kind == "array" and "items" in rule and typed_as_asked:
        item_error = _items_error(f, rule["items"])
        checks.append((item_error.isNotNull(), item_error))
    elif kind == "object" and rule.get("properties") and typed_as_asked:
        for prop in rule["properties"]:
            inner = _property(f, prop["name"])
            if prop.get("required"):
                checks.append((~inner.present, f"property {prop['name']} is missing"))
            prop_error = present_error(inner, prop)
            checks.append((inner.present & prop_error.isNotNull(),
                           F.concat(F.lit(f"property {prop['name']}: "), prop_error)))
    if rule.get("enum"):
        allowed = ", ".join(literal_text(v) for v in rule["enum"])
        checks.append((~_in_enum(f, rule["enum"]), f"must be one of {allowed}"))
    out = F.lit(None).cast("string")
    for broken, message in reversed(checks):
        out = F.when(broken, F.lit(message) if isinstance(message, str) else message).otherwise(out)
    return out


def _static_kind(f: Field, kind: str) -> bool:
    expected = {"string": T.StringType, "number": NUMERIC, "integer": NUMERIC,
                "array": T.ArrayType, "object": T.StructType}
    return kind in expected and isinstance(f.dtype, expected[kind])


def _in_enum(f: Field, values: list) -> Column:
    """Equality of value and type, unlike the filter's ``in``."""
    texts = [v for v in values if isinstance(v, str)]
    flags = [v for v in values if isinstance(v, bool)]
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    if f.variant:
        name = F.schema_of_variant(f.value)
        return ((name == "STRING") & f.text.isin(texts)) \
            | ((name == "BOOLEAN") & f.text.isin([literal_text(v) for v in flags])) \
            | F.coalesce(f.number.isin([float(n) for n in numbers]) & (name != "STRING"), F.lit(False))
    if isinstance(f.dtype, T.StringType):
        return f.value.isin(texts)
    if isinstance(f.dtype, T.BooleanType):
        return f.value.isin(flags)
    return f.number.isin([float(n) for n in numbers])


def _property(f: Field, name: str) -> Field:
    if f.variant:
        return _as_field(F.try_variant_get(f.value, variant_path(name), "variant"), T.VariantType())
    if name not in f.dtype.names:
        return Field(F.lit(None).cast("string"), T.StringType(), F.lit(False), F.lit(True))
    return _as_field(f.value.getField(name), f.dtype[name].dataType)


def _items_error(f: Field, rule: dict) -> Column:
    """Error of the first bad array item, with its index."""
    items = F.try_variant_get(f.value, "$", "array<variant>") if f.variant else f.value
    dtype = T.VariantType() if f.variant else f.dtype.elementType

    def labelled(item: Column, index: Column) -> Column:
        error = present_error(_as_field(item, dtype), rule)
        return F.when(error.isNotNull(), F.concat(F.lit("item ["), index.cast("string"), F.lit("]: "), error))

    return F.get(F.filter(F.transform(items, labelled), lambda e: e.isNotNull()), F.lit(0))


def present_error(f: Field, rule: dict) -> Column:
    """Message for a field that is present, possibly as null."""
    on_null = F.lit("null is not allowed") if rule.get("required") else F.lit(None).cast("string")
    return F.when(f.null, on_null).otherwise(value_error(f, rule))


def field_error(record, rule: dict) -> Column:
    """Message for one field of the record, NULL when it is valid."""
    f = record.field(rule["name"])
    missing = F.lit("required field is missing") if rule.get("required") else F.lit(None).cast("string")
    return F.when(~f.present, missing).otherwise(present_error(f, rule))


def undefined_fields(record, schema: dict) -> Column:
    """Names of present top-level fields the schema does not define.

    A dotted rule such as ``user.name`` defines ``user``.
    """
    defined = sorted({path_parts(f["name"])[0] for f in schema["fields"]})
    if isinstance(record, VariantRecord):
        keys = F.map_keys(F.try_variant_get(record.column, "$", "map<string,variant>"))
        return F.array_sort(F.array_except(keys, F.array(*[F.lit(d) for d in defined]).cast("array<string>")))
    extra = [n for n in record.schema.names if n not in defined]
    named = [F.when(record.field(n).present, F.lit(n)) for n in sorted(extra)]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def errors(record, schema: dict) -> Column:
    """All errors of a record, in field order, then the undefined fields of a strict schema."""
    schema = schema_from_dict(schema)
    found = []
    for rule in schema["fields"]:
        message = field_error(record, rule)
        found.append(F.when(message.isNotNull(),
                            F.struct(F.lit(rule["name"]).alias("field"), message.alias("message"))))
    listed = F.array_compact(F.array(*found)).cast(ERROR_TYPE) if found else F.array().cast(ERROR_TYPE)
    if schema["strict"]:
        extra = F.transform(undefined_fields(record, schema), lambda n: F.struct(
            n.alias("field"), F.lit("field is not defined in the schema").alias("message")))
        listed = F.concat(listed, F.coalesce(extra.cast(ERROR_TYPE), F.array().cast(ERROR_TYPE)))
    return listed


def error_text(listed: Column | str = ERRORS) -> Column:
    """``field: message`` of all errors, joined with ``; ``."""
    listed = F.col(listed) if isinstance(listed, str) else listed
    return F.array_join(F.transform(listed, lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")


def single_field_error(df: DataFrame, schema: dict, name: str, variant: str | None = None) -> Column:
    """Error of one field; asking for a field the schema does not define is an error too."""
    for rule in schema_from_dict(schema)["fields"]:
        if rule["name"] == name:
            return field_error(_record(df, variant), rule)
    return F.lit(f"field {name} is not defined in the schema")


def _record(df: DataFrame, variant: str | None):
    return VariantRecord(variant) if variant else TypedRecord(df.schema)


def check(df: DataFrame, schema: dict, variant: str | None = None) -> DataFrame:
    """Add ``_errors`` to every row."""
    return df.withColumn(ERRORS, errors(_record(df, variant), schema))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(ERRORS) == 0).drop(ERRORS)


def quarantine(checked: DataFrame) -> DataFrame:
    """Rejected rows with their errors."""
    return checked.filter(F.size(ERRORS) > 0)


def validate(df: DataFrame, schema: dict, drop_on_fail: bool = False, variant: str | None = None, rejects=None) -> DataFrame:
    """Validation stage: only valid rows go on, so a bad record never fails the job nor reaches a sink.

    Rejected rows, marked with ``_errors``, are handed to ``rejects`` unless ``drop_on_fail`` says to drop them unseen.
    """
    checked = check(df, schema, variant)
    if rejects is not None and not drop_on_fail:
        rejects(quarantine(checked))
    return valid(checked)


def valid_counts(checked: DataFrame) -> DataFrame:
    """One row: valid, invalid."""
    return checked.agg(F.count_if(F.size(ERRORS) == 0).alias("valid"),
                       F.count_if(F.size(ERRORS) > 0).alias("invalid"))
