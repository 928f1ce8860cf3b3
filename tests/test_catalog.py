from functools import partial

import duckdb
import pandas as pd
import pytest

from touchline.operators import gbdt
from touchline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def tidy(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype == "float64" or frame[c].map(type).eq(float).any():
            frame[c] = frame[c].astype(float).round(5)
    return frame.astype(object).where(frame.notna(), None).sort_values(list(frame.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = tidy(got), tidy(want)
    assert len(a) == len(b)
    for c in a.columns:
        for x, y in zip(a[c], b[c], strict=True):
            assert x == y or abs(float(x) - float(y)) < 2e-5, (c, x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_have_rows(spark, name, monkeypatch):
    """Boosted queries with few rounds here; ``test_operators`` checks that they ask for the production setting."""
    monkeypatch.setattr(gbdt, "BoostConfig", partial(gbdt.BoostConfig, rounds=3))
    assert catalog.QUERIES[name](spark, SF).count() > 0
