import pytest
from pyspark.sql import functions as F

from sluice.functions import scalars as X
from sluice.operators import routing as R, shaping as S


def one(df):
    return df.first().asDict()


def test_transform_reads_incoming_record(spark):
    df = spark.createDataFrame([("value", "val1")], "old_field string, source1 string")
    out = one(S.transform(df, "# note\n\nold_field = .source1\ncopy = .old_field\nlit = \"x\"\nbad = now()\nnone = .absent"))
    assert out == {"old_field": "val1", "source1": "val1", "copy": "value", "lit": "x"}


def test_select_and_exclude(spark):
    df = spark.createDataFrame([("test", "secret123", "api-key", "data")], "name string, password string, secret string, public string")
    assert S.exclude(df, ["password", "secret", "x"]).columns == ["name", "public"]
    assert S.select(df, ["public", "x", "name"]).columns == ["public", "name"]


def test_sample_share(spark):
    df = spark.range(10_000)
    assert 4000 <= R.sample(df, 0.5, 1).count() <= 6000
    assert R.sample(df, 0).count() == 10_000


def test_step_order(spark):
    df = spark.createDataFrame([("active", 1), ("off", 2)], "status string, n int")
    out = S.step(df, "state = .status", ".state == 'active'", 0, ["state", "n"], ["n"])
    assert [r.asDict() for r in out.collect()] == [{"state": "active"}]


@pytest.mark.parametrize("first,last,expected", [(0, 0, "******"), (2, 1, "se***t"), (3, 3, "******"), (9, 0, "******")])
def test_mask(spark, first, last, expected):
    df = spark.createDataFrame([("secret",)], "s string")
    assert df.select(S.mask(F.col("s"), "*", first, last)).first()[0] == expected


def test_aes_needs_key(spark):
    with pytest.raises(ValueError):
        S.encrypt(spark.createDataFrame([("a",)], "s string"), ["s"], "aes256", key_env="SLUICE_NO_SUCH_KEY")


def test_cast_errors(spark):
    df = spark.createDataFrame([("12", "yes"), ("x", "no"), (None, None), ("3.7", "maybe")], "n string, b string")
    assert [r["n"] for r in S.cast(df, {"n": "int"}).collect()] == [12, None, None, 3]
    assert [r["n"] for r in S.cast(df, {"n": "int"}, on_error="drop").collect()] == [12, None, 3]
    assert [r["n"] for r in S.cast(df, {"n": "int"}, on_error="keep").collect()] == ["12", "x", None, "3"]
    assert [r["b"] for r in S.cast(df, {"b": "bool"}).collect()] == [True, False, None, None]


def test_remap_precedence(spark):
    df = spark.createDataFrame([('{"a": "parsed", "processed_at": "m"}', "old"), ("no json", "old2")], "message string, b string")
    out = S.remap(df, {"a": "b"}, message_schema="a string, processed_at string", processed_at=F.lit("now"))
    assert [(r["a"], r["processed_at"]) for r in out.collect()] == [("old", "m"), ("old2", None)] or \
        [(r["a"], r["processed_at"]) for r in out.collect()] == [("old", "m"), ("old2", "now")]


def test_split_without_match_is_null(spark):
    df = spark.createDataFrame([("a-1",), ("none",)], "s string")
    out = S.split(df, "s", r"^([a-z])-(\d)$", ["l", "d"], keep_original=False)
    assert [tuple(r) for r in out.collect()] == [("a", "1"), (None, None)]


@pytest.mark.parametrize("layout,expected", [
    ("2006-01-02T15:04:05Z07:00", "yyyy-MM-dd'T'HH:mm:ssXXX"), ("%Y.%m.%d", "yyyy.MM.dd"), ("yyyy/MM", "yyyy/MM"),
])
def test_date_pattern(layout, expected):
    assert X.date_pattern(layout) == expected


def test_require_raises(spark):
    df = spark.createDataFrame([(None,)], "s string")
    with pytest.raises(Exception):
        df.select(X.require(F.col("s"), "missing")).collect()


def test_route_modes(spark):
    df = spark.range(6)
    routes = [({"field": "id", "op": "lt", "value": 2}, "a"), ({"field": "id", "op": "lt", "value": 4}, "b")]
    assert [r["_route"] for r in R.route_first(df, routes).orderBy("id").collect()] == ["a", "a", "b", "b"]
    assert R.route_all(df, routes).count() == 6
    assert R.branch(R.route_first(df, routes, "rest"), "rest").count() == 2


def test_spread_by_key_is_stable(spark):
    df = spark.range(1000)
    first = R.spread_by_key(df, ["a", "b"], F.col("id")).groupBy("_route").count().collect()
    assert {r["_route"] for r in first} == {"a", "b"} and all(400 < r["count"] < 600 for r in first)
