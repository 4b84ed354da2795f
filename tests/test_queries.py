"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from catalog.oracle import ORACLE
from catalog.queries import QUERIES

SAMPLE = ["client_ip", "eligibility", "count_requests", "batch_flush_session", "strict_ip_dedup", "counters_all_ranges",
          "running_counts", "rollover_snapshot", "top_total", "top_by_terms", "ranking_tabs", "format_counts", "wday_shape",
          "hot_topics", "rank_fusion", "fatigue_history", "similarity", "trending_full", "stream_hours", "stream_bins",
          "stream_ingest_strict", "pruned_counters", "trending_by_segment", "counters_sweep",
          "counters_sweep_archives", "hourly_candidates", "counters_partials", "stream_viewer_index", "request_feed",
          "rollover_forced", "daily_late"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(SAMPLE) <= set(oracle)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = check.rows_of(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    assert got == check.rows_of([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
