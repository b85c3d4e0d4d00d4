"""Every query of the core against its SQL at the smallest scale."""

import glob
import os

import pytest

from vistaframe.plans import registry

FOLDER = os.environ.get("SQL_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    from verify import plain

    df = registry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def test_flagship(spark):
    if os.path.isdir(FOLDER):
        assert registry.flagship(spark, FOLDER).count() > 0
