"""Every query of the product-monitoring model against its SQL in DuckDB, over all driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from shelfline.plans import registry

SF_DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that compares and sorts alike whichever engine made it."""
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return ("n", "nan" if math.isnan(number) else float(f"{number:.9g}"))
    if hasattr(value, "isoformat"):
        return ("t", value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", str([plain(x) for x in value]))
    return ("s", str(value))


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    expected = duck.execute(SQL[name])
    names = [c[0] for c in expected.description]
    theirs = rows(names, expected.fetchall())
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF_DIR)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()
