import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomstead.operators import analysis

D = dt.date
NAMES = [f"f{i}" for i in range(12)]


def trajectories(spark):
    lines = {"a": ("01001", [0.0] + [20.0] * 48), "b": ("01001", [2.0] * 49), "c": ("01003", [5.0] * 49), "d": ("01005", [7.0] * 49), "e": ("01007", [1.0] * 49)}
    return spark.createDataFrame([(n, f, m - 12, v, "Low") for n, (f, vs) in lines.items() for m, v in enumerate(vs)], "line_id string, fips string, event_window_month int, x double, rating string")


def test_feature_analysis(spark):
    feats = spark.createDataFrame([(f, "Low", *[float(i)] * 12) for i, f in enumerate(("01001", "01003", "01005", "01007"), 1)], "fips string, rating string, " + ", ".join(f"{n} double" for n in NAMES))
    out = analysis.feature_analysis(feats, NAMES, trajectories(spark), "line_id", "fips", "rating", "x", ["Low"])
    assert {r["fips"]: r["subgroup"] for r in out["members"].collect()} == {"01001": 0, "01005": 1, "01003": 2, "01007": 3}
    assert out["targets"].filter("fips = '01001'").first()["target"] == 11.0
    monthly = {r["event_window_month"]: r["median"] for r in out["monthly"].filter("subgroup = 0").collect()}
    assert monthly[-12] == 1.0 and monthly[-11] == 11.0
    assert out["correlations"].count() == 12 and out["traits"].count() == 12 and not any(r["passes_threshold"] for r in out["correlations"].collect())
    assert out["trait_bands"].count() == 48 and out["subgroups"].count() == 4


def test_window_view(spark):
    out = analysis.window_view(trajectories(spark), "line_id", "fips", "rating", "x")
    lines = {r["line_id"]: r for r in out["lines"].collect()}
    assert lines["a"]["pct_rank"] == 100.0 and lines["e"]["pct_rank"] == 20.0 and len(lines) == 5
    assert out["bands"].count() == 49 and out["summary"].first()["units"] == 4
    assert {r["fips"]: r["county_pct"] for r in out["units"].collect()}["01001"] == 100.0


@pytest.fixture
def panel(spark):
    months = [D(2014 + i // 12, i % 12 + 1, 1) for i in range(150)]
    return spark.createDataFrame([(f, m, float(i % 12 + k)) for k, f in enumerate(("01001", "01003")) for i, m in enumerate(months) if not (f == "01003" and i == 130)], "fips string, month date, x double")


def test_price_risk(spark, panel):
    risk = spark.createDataFrame([("01001", "Low"), ("01003", "Low")], "fips string, rating string")
    out = analysis.price_risk(panel, risk, "fips", "rating", "month", "x")
    assert {r["fips"]: r["latest_mean"] for r in out["latest"].collect()}["01001"] == 5.5
    assert out["bands"].count() == 120 and out["bands"].filter("q1 != q3").count() == 0
    assert all(len(r["series"]) == 120 for r in out["history"].collect())
    with pytest.raises(ValueError):
        analysis.price_risk(panel.limit(5), risk, "fips", "rating", "month", "x")


EVENTS = "event_key string, fips string, event_type string, event_start date, event_end date, has_fema boolean, has_noaa boolean, total_damage_amount double"


def test_histories_and_marts(spark, panel):
    ev = spark.createDataFrame([("k1", "01001", "Flood", D(2017, 3, 5), None, True, False, None), ("k2", "01001", "Biological", D(2017, 3, 5), None, True, False, None), ("k3", "01001", "Flood", D(2014, 3, 5), None, True, False, None)], EVENTS)
    risk = spark.createDataFrame([("01001", "Very Low"), ("01003", "Very High")], "fips string, rating string")
    out = analysis.analysis_marts(ev, panel, risk, "fips", "rating", "month", ["x"])
    assert [r["event_key"] for r in out["extreme_events_county"].collect()] == ["k1"]
    assert out["housing_event_windows_monthly"].count() == 73
    levels = {(r["aggregation_level"], r["risk_rating"]) for r in out["housing_event_window_summary"].collect()}
    assert levels == {("all_counties", None), ("nri_risk_rating", "Very Low")}
    assert out["housing_event_window_summary"].filter("aggregation_level = 'all_counties' and horizon_months = 12").count() == 25
    hist = {r["fips"]: r for r in analysis.county_histories(panel, out["extreme_events_county"], "fips", "month", "x").collect()}
    assert len(hist["01001"]["events"]) == 1 and hist["01003"]["events"] == [] and hist["01003"]["sufficient"]
    with pytest.raises(ValueError):
        analysis.story_lines(out["extreme_events_county"], ["k9"], "event_key")
    assert analysis.story_lines(out["extreme_events_county"], ["k1"], "event_key").count() == 1
    assert out["event_window_config"].filter(F.col("parameter") == "post_months").first()["value"] == "60"
