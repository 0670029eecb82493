import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and blank texts, repeated rows and ids, ties, and columns with names used inside."""
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    rows = [(1, "a b  c", "s1"), (2, "a b c", "s1"), (2, "a b c", "s1"), (3, None, None), (4, "", "s2"), (5, " \t\n", "s2"),
            (None, "a b c", "s2"), (None, None, None), (6, long, "s1"), (7, long, None), (8, " a b c", "s3"), (8, "other", "s3"),
            (9, "MIT License and mit license, Apache License; CC-BY", "s3"), (10, "é É ß 　 x", "s1")]
    return spark.createDataFrame([(*r, "en", 1, 2, "t", 3) for r in rows],
                                 "doc_id long, text string, source string, lang string, row long, taken long, h string, start long")


def sql(spark, query: str, folder: str = SMALL) -> list[tuple]:
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con.sql(query).fetchall()
