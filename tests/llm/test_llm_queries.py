from pathlib import Path

import duckdb
import pytest

from quern.llm.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.toPandas()
    assert len(rows.columns) == len(df.columns)
    if name in SQL:
        c = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        want = c.sql(SQL[name]).df()
        key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values.tolist()))
        assert key(rows) == key(want)
