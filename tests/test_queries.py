"""Every query with SQL gives what DuckDB gives on the same tables."""

from pathlib import Path

import duckdb
import pytest

from cubeloom import queries

TABLES = Path("/root/testdata/sf0.01")
TYPES = {"int": "int32", "bigint": "int64", "double": "double", "float": "float", "string": "string", "smallint": "int16", "boolean": "bool"}


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        out.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return out


def _key(row):
    return tuple((x is None, repr(round(x, 7)) if isinstance(x, float) else repr(x)) for x in row)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    found = queries.queries()[name](spark, str(TABLES))
    table = con.execute(queries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(found.columns)
    assert columns == sorted(table.column_names)
    assert [TYPES[found.schema[c].dataType.simpleString()] for c in columns] == [str(table.schema.field(c).type) for c in columns]
    assert sorted(_key([r[c] for c in columns]) for r in found.collect()) == sorted(_key([r[c] for c in columns]) for r in table.to_pylist())


def _same_on_more_rows(spark, name):
    """On sf0.1 there are ground points on the very edge between two posts of the elevation model."""
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    table = con.execute(queries.oracle_sql()[name]).to_arrow_table()
    found = queries.queries()[name](spark, "/root/testdata/sf0.1")
    columns = sorted(found.columns)
    assert sorted(_key([r[c] for c in columns]) for r in found.collect()) == sorted(_key([r[c] for c in columns]) for r in table.to_pylist())


def test_ortho_nearest_on_more_rows(spark):
    _same_on_more_rows(spark, "ortho_nearest")


def test_ortho_tiles_nearest_on_more_rows(spark):
    _same_on_more_rows(spark, "ortho_tiles_nearest")


def test_flagship_and_inventory(spark):
    assert queries.flagship(spark, str(TABLES)).count() > 0
    rows = queries.queries()["file_inventory"](spark, str(TABLES)).collect()
    assert [r["kind"] for r in rows] == ["other"] and rows[0]["files"] == len(list(TABLES.iterdir()))


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.tall_cube(spark, str(TABLES)).filter("l_orderkey > 10")._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "ReadSchema" in x and "lineitem" in x)
    assert "GreaterThan(l_orderkey,10)" in scan and "l_comment" not in scan and "l_shipdate" not in scan
