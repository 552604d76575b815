"""The driver contract, and a sample of the queries against SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from perfcap.plans import registry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["a1_a5_series_stats_events", "f3_duration_percent_events", "w4_gap_count", "c4_a15_l4_trends",
          "c5_j7_a16_l5_correlations", "s2_split_cells", "s4_numbers", "n1_metrics", "f11_pack_violations"]


def test_every_oracle_has_a_query():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(registry.QUERIES) <= set(queries)
    assert set(registry.QUERIES) - set(registry.SQL) == {"k2_markdown", "k3_html"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_module.queries()[name](spark, SF)
    result = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    mine = rows_of(df.columns, df.collect())
    assert mine and mine == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
