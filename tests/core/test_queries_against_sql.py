"""Every query with SQL returns what the SQL returns, at the smallest scale."""

import duckdb
import pytest

from freshet.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool | str):
        return value
    return round(float(value), 5)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[i]) for i in order) for r in expected.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"model_calibrate", "model_forest", "geo_merged_regions"}))
def test_runs(spark, name):
    """Queries without SQL, whose values other tests confirm: they give rows, none of them all null."""
    # no gauge of the smallest scale has all 366 days
    rows = catalog.QUERIES[name](spark, SF.replace("0.001", "0.01") if name == "clus_smoothed_regimes" else SF).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
