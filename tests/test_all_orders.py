"""The event queries over all orders against their SQL without its cut, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.test_entry import duck, norm  # noqa: F401

CUT = "WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)"
NAMES = (
    "event_window_quartiles", "complete_window_summary", "complete_line_filter", "event_phase_counts", "state_month_baseline", "median_of_medians", "mean_by_key", "event_expectation", "band_fit",
    "eligible_event_range", "window_view_lines", "feature_members", "unit_histories",
)


@pytest.mark.parametrize("name", NAMES)
def test_all_orders_are_events(spark, sf, duck, name):  # noqa: F811
    sql = entry.oracle_sql()[name]
    assert sql.count(CUT) == 1
    df = entry.queries()[f"{name}_all_orders"](spark, sf)
    r = duck.execute(sql.replace(CUT, ""))
    at = [x[0] for x in r.description]
    assert sorted(at) == sorted(df.columns)
    got = sorted((tuple(norm(x[c]) for c in at) for x in df.collect()), key=str)
    assert got == sorted((tuple(map(norm, x)) for x in r.fetchall()), key=str)


def test_feature_correlations_over_all_orders(spark, sf):
    n = {k: entry.queries()[k](spark, sf).count() for k in ("feature_correlations", "feature_correlations_all_orders")}
    assert n["feature_correlations_all_orders"] >= n["feature_correlations"]
