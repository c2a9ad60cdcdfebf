"""The driver's contract: queries and SQL agree on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = ("event_window_quartiles", "complete_line_filter", "state_month_baseline", "interval_islands", "interval_overlap_pairs", "cross_source_best_match", "conditional_pivot", "percent_rank_avg", "equal_groups4", "spearman_by_group", "p2_found", "p3_found", "p5_found", "p7_found", "canonical_incidents")


def norm(v):
    return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["risk_rating", "event_window_month", "q1", "median", "q3"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    r = duck.execute(entry.oracle_sql()[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    assert got == sorted((tuple(norm(x[at.index(c)]) for c in cols) for x in r.fetchall()), key=str)
