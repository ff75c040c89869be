"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from gaugeflow.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'").fetchall()
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(cursor.fetchall(), names) == canonical(rows, df.columns)


def test_west_to_east_with_equal_longitudes(spark, tmp_path):
    """Longitudes repeat every 5,000 keys; some lie on the border of two regions."""
    path = tmp_path / "supplier.parquet"
    duckdb.execute(f"COPY (SELECT (i * 7919) % 12000 AS s_suppkey, (CASE WHEN i % 97 > 0 THEN i % 25 END)::INT AS s_nationkey FROM range(12000) r(i)) TO '{path}'")
    rows = [tuple(r) for r in catalog.QUERIES["west_to_east"](spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted(duckdb.sql(catalog.SQL["west_to_east"].replace("FROM supplier", f"FROM '{path}'")).fetchall())
