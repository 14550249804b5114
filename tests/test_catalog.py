"""Each query against the SQL that it must agree with, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sequenza.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    """Rows as sorted strings, columns by name."""
    df = df[sorted(df.columns)]
    value = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else round(float(x), 6) if hasattr(x, "__float__") and not isinstance(x, (bool, str)) else str(x)
    return sorted(str([value(x) for x in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_same_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    expected = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["stateful_map_general", "streaming_fold"])
def test_a_fold_whose_state_comes_to_zero(spark, tmp_path, name):
    """7 * 31 + 999786 is the prime: the next row goes on from 0, not from the start."""
    events = [(k, f"2024-01-0{k + 1} 00:00:00", 1, value) for k, value in enumerate((9997.86, 1.0, 2.0))]
    spark.createDataFrame(events, "event_id long, t string, user_id long, value double").selectExpr("event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "user_id", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(tmp_path)).where("event_id IS NOT NULL").toPandas()
    assert got.sort_values("event_id")["state"].tolist()[:2] == [0, 100]
    assert rows(got) == rows(con.execute(catalog.oracle_sql()[name]).df())
