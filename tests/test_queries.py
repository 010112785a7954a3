"""Every registered query gives the rows of its SQL twin."""
import decimal
from pathlib import Path

import duckdb
import pytest

from sheafline.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert cols == sorted(want.columns)
    got = sorted(str([plain(x) for x in r]) for r in df.select(*cols).collect())
    assert got == sorted(str([plain(x) for x in r]) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_twin_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
