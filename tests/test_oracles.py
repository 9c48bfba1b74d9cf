"""Every query that has SQL gives the rows that the SQL gives in another engine."""

import os

import duckdb
import pytest

from quarry import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{data}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return repr(value)


def kind(name):
    name = str(name).upper()
    return {"INTEGER": "INT", "VARCHAR": "STRING"}.get(name, name)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, other, name):
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    found = other.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    want = sorted(str([plain(r[k]) for k in places]) for r in found.fetchall())
    assert len(rows) == len(want)
    assert rows == want
    types = {f.name: f.dataType.simpleString().upper() for f in df.schema.fields}
    for c, t in zip(found.columns, found.types):
        if "[" not in str(t):
            assert kind(types[c]) == kind(t), c
