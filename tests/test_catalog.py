"""Every query beside its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docuquarry import catalog, catalog_documents, catalog_evaluation, catalog_extraction, catalog_plans, catalog_registers  # noqa: F401  (register their queries)

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.SQL:
        assert df.columns
        return
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert ours == theirs
