import json

import pytest
from pyspark.sql import functions as F

from sluice.functions.values import VariantRecord
from sluice.operators import validate as V


def messages(spark, record: dict, schema: dict) -> list[tuple]:
    df = spark.range(0, 1, 1, 1).select(F.parse_json(F.lit(json.dumps(record))).alias("rec"))
    return [(e["field"], e["message"]) for e in df.select(V.errors(VariantRecord("rec"), schema).alias("e")).first()["e"]]


PERSON = {"fields": [{"name": "name", "type": "string", "required": True}, {"name": "age", "type": "number"},
                     {"name": "email", "type": "string", "required": True}], "strict": False}
USERNAME = {"fields": [{"name": "username", "type": "string", "min_length": 3, "max_length": 10, "pattern": "^[a-z]+$"}]}
SCORE = {"fields": [{"name": "score", "type": "number", "min": 0, "max": 100}]}
STATUS = {"fields": [{"name": "status", "type": "string", "enum": ["pending", "active", "completed"]}]}
TAGS = {"fields": [{"name": "tags", "type": "array", "items": {"type": "string"}}]}
ADDRESS = {"fields": [{"name": "address", "type": "object", "required": True, "properties": [
    {"name": "city", "type": "string", "required": True}, {"name": "zip", "type": "string", "required": True}]}]}
USER = {"fields": [{"name": "user.name", "type": "string", "required": True}, {"name": "user.age", "type": "number", "required": True}]}


@pytest.mark.parametrize("record,schema,bad", [
    ({"name": "John", "age": 30, "email": "j@x"}, PERSON, []),
    ({"name": "John", "age": 30}, PERSON, ["email"]),
    ({"name": 5, "age": "x", "email": None}, PERSON, ["name", "age", "email"]),
    ({"name": "J", "email": "e", "extra": 1}, PERSON, []),
    ({"name": "J", "email": "e", "extra": 1}, PERSON | {"strict": True}, ["extra"]),
    ({"username": "john"}, USERNAME, []),
    ({"username": "ab"}, USERNAME, ["username"]),
    ({"username": "verylongusername"}, USERNAME, ["username"]),
    ({"username": "John123"}, USERNAME, ["username"]),
    ({"score": 50}, SCORE, []), ({"score": -5}, SCORE, ["score"]), ({"score": 150}, SCORE, ["score"]), ({"score": 100}, SCORE, []),
    ({"status": "active"}, STATUS, []), ({"status": "invalid"}, STATUS, ["status"]),
    ({"tags": ["go", "rust", "python"]}, TAGS, []), ({"tags": ["go", 123, "python"]}, TAGS, ["tags"]), ({"tags": "go"}, TAGS, ["tags"]),
    ({"address": {"city": "Seoul", "zip": "12345"}}, ADDRESS, []), ({"address": {"city": "Seoul"}}, ADDRESS, ["address"]),
    ({"user": {"name": "John", "age": 30}}, USER, []), ({"user": {"name": "John"}}, USER, ["user.age"]),
    ({"user": {"name": "John", "age": 30}}, USER | {"strict": True}, []),
    ({"n": 5.0}, {"fields": [{"name": "n", "type": "integer"}]}, []),
    ({"n": 5.5}, {"fields": [{"name": "n", "type": "integer"}]}, ["n"]),
    ({"n": True}, {"fields": [{"name": "n", "type": "number"}]}, ["n"]),
    ({"b": True}, {"fields": [{"name": "b", "type": "boolean", "enum": [True]}]}, []),
    ({"n": 1}, {"fields": [{"name": "n", "type": "any", "enum": ["1"]}]}, ["n"]),
    ({"n": 2}, {"fields": [{"name": "n", "type": "any", "enum": [1, 2.0]}]}, []),
])
def test_record(spark, record, schema, bad):
    assert [f for f, _ in messages(spark, record, schema)] == bad


def test_item_index(spark):
    assert messages(spark, {"tags": ["go", 123, "python"]}, TAGS)[0][1].startswith("item [1]")


def test_byte_length(spark):
    rule = {"fields": [{"name": "s", "type": "string", "max_length": 1}]}
    assert messages(spark, {"s": "é"}, rule) and not messages(spark, {"s": "e"}, rule)


def test_unknown_type():
    with pytest.raises(ValueError):
        V.schema_from_dict({"fields": [{"name": "a", "type": "decimal"}]})


def test_typed_matches_schemaless(spark):
    rows = [("John", 30.0, "e"), (None, 2.5, None), ("x", None, "y")]
    df = spark.createDataFrame(rows, "name string, age double, email string")
    by_type = [r[0] for r in V.check(df, PERSON).select(V.error_text()).collect()]
    assert by_type == ["", "name: required field is missing; email: required field is missing", ""]


def test_split(spark):
    df = spark.createDataFrame([(5.0,), (500.0,)], "score double")
    checked = V.check(df, SCORE)
    rejected = []
    assert V.validate(df, SCORE, rejects=rejected.append).count() == V.valid(checked).count() == V.validate(df, SCORE, True).count()
    assert rejected[0].count() == V.quarantine(checked).count()
    assert V.valid(checked).count() == 1 and V.quarantine(checked).count() == 1
    assert V.valid_counts(checked).first().asDict() == {"valid": 1, "invalid": 1}
