"""Every registered query has a stable shape; a few run beside their SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tools.check import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
RUN = ["features_1d", "auth_normalize", "flow_windows", "pr_curve", "knn_topk", "running_quantity", "alert_rows"]


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 60


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", RUN)
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = driver.queries()[name](spark, SMALL)
    cur = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())
