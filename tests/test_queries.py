"""Every registered query of the core with an SQL form is compared with it on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quern.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6)) if v != int(v) else str(int(v))  # integers beside nulls come as floats
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)
    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_same_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.sql(registry.sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() > 0


def test_cells_recall(spark):
    exact = registry.queries()["cosine_topk"](spark, str(DATA)).toPandas()
    cells = registry.queries()["vector_cells"](spark, str(DATA)).toPandas()
    a, b = set(zip(exact.query_id, exact.id)), set(zip(cells.query_id, cells.id))
    assert len(a & b) >= 0.9 * len(a)
