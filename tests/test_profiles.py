"""Profiles of all columns against brute force, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from loomstead.plans.scores import _dist
from tests.test_entry import duck  # noqa: F401


def test_missingness_of_all_columns(spark, sf, duck):  # noqa: F811
    columns = [x[0] for x in duck.execute("DESCRIBE extreme_events_county").fetchall()]
    want = {c: duck.execute(f'SELECT count(*) - count("{c}") FROM extreme_events_county').fetchone()[0] for c in columns}
    got = {r["column_name"]: r["nulls"] for r in entry.queries()["profile_missingness_all_columns"](spark, sf).collect()}
    assert got == want and got["total_damage_amount"] > 0


def test_distribution_of_all_numeric_columns(spark, sf, duck):  # noqa: F811
    got = {r["column_name"]: r.asDict() for r in entry.queries()["profile_quantiles_all_columns"](spark, sf).collect()}
    assert {"l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"} <= set(got)
    for c, row in got.items():
        r = duck.execute(_dist(c))
        want = dict(zip([x[0] for x in r.description], r.fetchone()))
        assert {k: row[k] for k in want if k != "column_name"} == pytest.approx({k: float(v) for k, v in want.items() if k != "column_name"}, abs=2e-4)
