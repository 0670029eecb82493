"""Run a registered query and its SQL twin side by side."""

from __future__ import annotations

import datetime
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _rows(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "huge",
         "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
         "timestamp": "time", "timestamp_ntz": "time", "timestamp with time zone": "time"}


def compare(spark, con, name: str, folder: str) -> str | None:
    """None when the results agree, else what differs; rows-only queries must give rows."""
    from sluice.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    got = df.collect()
    if name not in ORACLES:
        return None if got else "no rows"
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    theirs = {c[0]: KINDS.get(str(c[1]).lower().split("(")[0], str(c[1])) for c in result.description}
    ours = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if ours != theirs:
        return f"types {ours} against {theirs}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = _rows(df.columns, got), _rows(columns, want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import time

    from sluice.catalog import QUERIES
    from sluice.session import get_spark

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_spark("8")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    for n in names:
        start = time.time()
        try:
            problem = compare(spark, con, n, folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        spent = time.time() - start
        if problem:
            bad += 1
            print(f"BAD {n}: {problem[:900]}")
        elif spent > 5:
            print(f"slow {n}: {spent:.1f}s")
    print(f"{len(names)} queries, {bad} bad")
