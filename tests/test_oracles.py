"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from stormledger.plans import catalogue, details, feeds  # noqa: F401
from stormledger.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**catalogue.QUERIES, **jobs.QUERIES}
ORACLES = {**catalogue.ORACLES, **jobs.ORACLES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame, columns):
    rows = frame[columns].copy()
    for c in columns:
        if rows[c].dtype.kind == "f":
            rows[c] = rows[c].round(6)
        if str(rows[c].dtype).startswith("datetime"):
            rows[c] = rows[c].astype("datetime64[us]")
    return sorted(map(str, rows.astype(str).replace({"None": "nan", "<NA>": "nan"}).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert name in ORACLES
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(got, columns) == canonical(want, columns)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
