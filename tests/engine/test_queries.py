"""Every query that has a SQL twin returns the twin's rows."""

from pathlib import Path

import duckdb
import pytest

from braidwork import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, twin, name):
    df = catalog.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    want = twin.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == order
    rows = lambda cols, data: sorted((tuple(r[cols.index(c)] for c in order) for r in data), key=repr)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_others_run(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, FOLDER).count() > 0, name
