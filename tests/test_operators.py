"""The composites on small golden cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomstead.functions import clean, text
from loomstead.operators import events, geo, marts, playbook, quality, relational, stats, windows
from loomstead.operators.catalog import feature_catalog

D = dt.date


def declarations(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, fips string, disasterNumber string, declarationType string, incidentType string, declarationTitle string, incident_begin_date string, incident_end_date string, lastRefresh string")


EM = ("em-row", "13165", "3616", "EM", "Tropical Storm", "HURRICANE HELENE", "2024-09-24", "2024-10-07", "2024-10-01")
DR = ("dr-row", "13165", "4830", "DR", "Hurricane", "Hurricane Helene", "2024-09-24", "2024-10-07", "2024-11-01")


def test_declarations_of_one_incident(spark):
    (r,) = events.canonical_declarations(declarations(spark, EM, DR)).collect()
    assert (r["disasterNumber"], r["declarationType"], r["associated_disaster_numbers"], r["associated_declaration_types"], r["declaration_count"]) == ("4830", "DR", "3616|4830", "DR|EM", 2)
    assert r["canonicalization_reason"] == "fema_semantic_duplicate"


def test_declarations_apart(spark):
    later = ("x", "13165", "4999", "DR", "Hurricane", "Hurricane Helene", "2025-08-01", "2025-08-05", "2025-09-01")
    assert events.canonical_declarations(declarations(spark, DR, later)).count() == 2
    with pytest.raises(ValueError):
        events.canonical_declarations(spark.range(1))


def test_declarations_awkward(spark):
    odd = [("a", None, "1", "DR", None, None, "bad", None, None), ("b", None, "1", "DR", None, "", "bad", None, None)]
    assert events.canonical_declarations(declarations(spark, *odd)).count() == 2
    assert events.canonical_declarations(declarations(spark)).count() == 0


STORMS = "event_source string, source_event_id string, episode_id string, fips string, event_type string, event_name string, event_start date, event_end date, total_damage_amount double, source_record_count long"


def fema_side(spark, df):
    return df.select(F.lit("fema").alias("event_source"), F.col("disasterNumber").alias("source_event_id"), "fips", F.col("incidentType").alias("event_type"), F.col("declarationTitle").alias("event_name"), F.col("incident_begin_date").alias("event_start"), F.col("incident_end_date").alias("event_end"), F.lit(None).cast("double").alias("total_damage_amount"), "source_record_count", F.col("associated_disaster_numbers").alias("associated_source_event_ids"))


def test_cross_source_match(spark):
    storms = spark.createDataFrame([("noaa", "99001", "88001", "13165", "Hurricane", "Hurricane", D(2024, 9, 26), D(2024, 9, 27), 1.5e9, 1)], STORMS)
    (r,) = events.canonical_events(fema_side(spark, events.canonical_declarations(declarations(spark, EM, DR))), storms).collect()
    assert (r["source_event_id"], r["event_sources"], r["associated_source_event_keys"], r["semantic_duplicate_count"], r["canonicalization_reason"]) == ("4830", "fema|noaa", "fema:3616|fema:4830|noaa:99001", 2, "cross_source_match")
    assert r["event_key"] == "fema:4830:13165:2024-09-01" and r["total_damage_amount"] == 1.5e9 and r["source_record_count"] == 3


def test_distinct_episodes_stay_apart(spark):
    storms = spark.createDataFrame([("noaa", str(i), str(i * 10), "13165", "Hurricane", "Hurricane", D(2024, 9, 26), D(2024, 9, 27), 1.1e9, 1) for i in (1, 2)], STORMS)
    none = fema_side(spark, events.canonical_declarations(declarations(spark)))
    assert events.canonical_events(none, storms).count() == 2
    same = storms.withColumn("episode_id", F.lit("7"))
    (r,) = events.canonical_events(none, same).collect()
    assert (r["source_event_id"], r["canonicalization_reason"], r["associated_source_event_keys"]) == ("1", "noaa_episode_duplicate", "noaa:1|noaa:2")


def test_qualifying_events(spark):
    df = spark.createDataFrame([(1, True, False, "Flood", None), (2, True, False, "Biological", None), (3, True, True, "Biological", 2e9), (4, False, True, "Hail", 1.0), (5, True, False, None, None)], "id int, has_fema boolean, has_noaa boolean, event_type string, total_damage_amount double")
    ids = lambda c: {r["id"] for r in df.filter(c).collect()}
    assert ids(events.qualifies()) == {1, 3} and ids(events.qualifies(noaa=False)) == {1} and ids(events.qualifies(False, False)) == set()


@pytest.mark.parametrize("last,expected", [(7, (D(2016, 1, 1), D(2026, 1, 1))), (12, (D(2017, 1, 1), D(2027, 1, 1)))])
def test_latest_complete_year(spark, last, expected):
    months = [D(2025, m, 1) for m in range(1, 13)] + [D(2026, m, 1) for m in range(1, last + 1)]
    assert tuple(events.latest_complete_year(spark.createDataFrame([(m,) for m in months], "period date"), "period").first()) == expected


def test_islands_match_brute_force(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("ab"), D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 300))) for i in range(120)]
    data = [(i, k, s, s + dt.timedelta(days=rng.randint(0, 9))) for i, k, s in data]
    got = {r["id"]: r["island"] for r in relational.islands(spark.createDataFrame(data, "id int, k string, s date, e date"), ["k"], "s", "e", 7, ["id"]).collect()}
    for key in "ab":
        n, reach = 0, None
        for i, k, s, e in sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[3], d[0])):
            if reach is None or s > reach + dt.timedelta(days=7):
                n += 1
            reach = e if reach is None else max(reach, e)
            assert got[i] == n


def test_overlaps_match_brute_force(spark):
    rng = random.Random(6)
    data = [(i, rng.choice("ab"), D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 200))) for i in range(60)]
    data = [(i, k, s, s + dt.timedelta(days=rng.choice([0, 3, 90]))) for i, k, s in data]
    got = {(r["key_a"], r["key_b"]) for r in events.overlapping_pairs(spark.createDataFrame(data, "id int, k string, s date, e date"), ["k"], "id", "s", "e").collect()}
    assert got == {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}


def test_event_windows(spark):
    ev = spark.createDataFrame([("e1", "01001", D(2020, 1, 1), D(2020, 3, 1))], "line_id string, fips string, event_start_month date, event_end_month date")
    panel = spark.createDataFrame([("01001", D(2018 + i // 12, i % 12 + 1, 1), float(i)) for i in range(48)], "fips string, period date, x double")
    got = {r["event_window_month"]: r for r in windows.event_windows(ev, panel, "fips", "period", 12, 14).collect()}
    assert set(got) == set(range(-12, 15))
    assert got[0]["period"] == D(2020, 1, 1) and got[1]["period"] == D(2020, 4, 1) and got[1]["event_duration_months"] == 2
    assert got[13]["event_window_phase"] == "13-14 months after event end" and got[-3]["event_window_phase"].startswith("12 months before")


def test_complete_members(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0), ("b", 2, None), (None, 1, 1.0)], "k string, m int, v double")
    assert [r["k"] for r in relational.complete_members(df, ["k"], "m", value="v").collect()] == ["a"]
    assert relational.complete_members(df, ["k"], "m", size=0).count() == 0
    assert {r["k"] for r in relational.complete_members(df, ["k"], "m", F.col("m") == 1, 1).collect()} == {"a", "b"}


def test_median_of_medians(spark):
    data = [("01001", "a", x) for x in (0.0, 100.0, 100.0)] + [("01001", "b", 10.0)] * 3 + [("01003", "c", x) for x in (2.0, 4.0, 6.0)]
    got = {r["fips"]: r["target"] for r in stats.median_of_medians(spark.createDataFrame(data, "fips string, line string, v double"), ["fips"], ["line"], "v").collect()}
    assert got == {"01001": 55.0, "01003": 4.0}


def test_factor_top_up(spark):
    for rho, want in (([0.2, -0.1, 0.05, 0.01], {0, 1, 2}), ([0.5, -0.4, 0.3, -0.35, 0.2], {0, 1, 2, 3}), ([None, 0.2, -0.2], {1, 2})):
        df = spark.createDataFrame([(0, i, r) for i, r in enumerate(rho)], "g int, i int, rho double")
        out = relational.top_with_minimum(df, ["g"], "rho", 0.3, 3, ["i"]).orderBy("rn").collect()
        assert {r["i"] for r in out} == want


def test_equal_groups_and_ranks(spark):
    df = spark.range(6).withColumn("g", F.lit(1))
    assert [r[0] for r in df.select(relational.equal_groups(["g"], [F.col("id")])).collect()] == [0, 0, 1, 2, 2, 3]
    t = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, None)], "g int, v double")
    assert sorted((r[0] or 0) for r in t.select(relational.average_rank("v", ["g"])).collect()) == [0, 1.0, 2.5, 2.5]


def test_range_assignment(spark):
    groups = [(0, 0.08, 0.12), (1, 0.04, 0.07), (2, 0.0, 0.03), (3, -0.05, -0.01)]
    for value, want in ((0.09, 0), (0.15, 0), (-0.08, 3), (0.035, 1)):
        df = spark.createDataFrame([(i, lo, hi) for i, lo, hi in groups], "i int, lo double, hi double")
        inside, distance = playbook.subgroup_from_ranges(F.lit(value), F.col("lo"), F.col("hi"))
        assert df.orderBy(inside, distance, "i").first()["i"] == want


def test_historical_assignment(spark):
    cases = [((11, 10, 14, 6), "Mild Overperformer"), ((12, 10, 14, 6), "Strong Overperformer"), ((9, 10, 14, 6), "Mild Underperformer"), ((8, 10, 14, 6), "Strong Underperformer"), ((10, 10, 14, 6), "Mild Overperformer"), ((11, 10, 10, 10), "Strong Overperformer"), ((9, 10, 10, 10), "Strong Underperformer"), ((None, 10, 14, 6), None)]
    for (a, b, c, d), want in cases:
        df = spark.createDataFrame([(a and float(a), float(b), float(c), float(d))], "a double, b double, c double, d double")
        assert df.select(playbook.historical_assignment(*[F.col(x) for x in "abcd"])).first()[0] == want


def test_scorecard_and_factors(spark):
    df = spark.createDataFrame([("Low", "Mild Overperformer", 1, "Low"), ("Low", "Mild Underperformer", 1, "Moderate"), ("High", "Mild Underperformer", -1, "High"), ("Low", None, 1, "Insufficient data")], "r string, p string, b int, want string")
    assert all(r[0] == r[1] for r in df.select(playbook.scorecard(F.col("r"), F.col("p"), F.col("b")), "want").collect())
    g = spark.createDataFrame([(2.0, 1.0, 0.5), (2.0, 1.0, -0.5), (1.0, 1.0, 0.5), (None, 1.0, 0.5)], "x double, m double, rho double")
    assert [r[0] for r in g.select(playbook.factor_growth(playbook.factor_position(F.col("x"), F.col("m")), F.col("rho"))).collect()] == [1, -1, 0, None]


def test_peers_and_bootstrap(spark):
    lines = spark.createDataFrame([("Low", f"l{i}", f"f{i % 4}", i * 20.0, i != 2, float(i), float(i)) for i in range(6)], "g string, line string, fips string, pct double, ok boolean, dev double, mdev double")
    got = stats.spaced_peers(lines, "g", "line", "fips", "pct", "ok", "dev", "mdev", 8).collect()
    assert len(got) == 4 and len({r["fips"] for r in got}) == 4
    b = spark.createDataFrame([("g", float(i), float(i * i), 7) for i in range(30)] + [("h", 1.0, 1.0, 7)], "g string, x double, y double, seed int")
    out = {r["g"]: r for r in stats.bootstrap_interval(b, ["g"], "x", "y", "seed").collect()}
    assert out["g"]["ci_low"] > 0.9 and out["h"]["ci_low"] is None


def test_cleaning(spark):
    t = spark.createDataFrame([("10.00K",), ("2.5M",), ("1B",), ("",), ("abc",), (None,)], "d string")
    assert [r[0] for r in t.select(clean.damage_amount("d")).collect()] == [10_000.0, 2_500_000.0, 1e9, 0.0, 0.0, 0.0]
    w = spark.createDataFrame([("5.5",), ("2015.0",), ("1e3",), ("x",)], "s string")
    assert [r[0] for r in w.select(clean.whole("s")).collect()] == [6, 2015, 1000, None]
    y = spark.createDataFrame([("24-APR-16 18:30:00",), ("01-JAN-96 00:00:00",)], "t string")
    assert [r[0].year for r in y.select(clean.two_digit_year_timestamp("t")).collect()] == [2016, 1996]
    assert clean.measure_never_negative("median_price") and not clean.measure_never_negative("price_yoy") and not clean.measure_never_negative("fips")
    n = spark.createDataFrame([("-1,000", "-1,000", "x")], "total_amount string, price_change string, `MEDIAN PRICE ($)` string")
    assert tuple(clean.clean_negatives(n).first()) == (None, "-1,000", "x")
    assert spark.range(1).select(clean.rate_text(F.lit("1"), F.lit("8")), clean.rate_text(F.lit("1"), F.lit("0"))).first() == ("12.50000000", "")


def test_names(spark):
    assert text.raw_variable_column("DP03_0062PE") == "dp03_0062_pct" and text.variable_of_column("dp03_0062_pct") == "DP03_0062PE"
    assert text.feature_name("Percent!!EDUCATIONAL ATTAINMENT!!High school graduate or higher") == text.feature_name("Percent!!EDUCATIONAL ATTAINMENT!!Population 25 years and over!!High school graduate or higher")
    assert len(text.feature_name("x" * 300)) == 140 and text.feature_name("5 years")[0] == "n"


def test_year_routing(spark):
    df = spark.createDataFrame([("2018", "08", "001", "87.0", "20.0", "3.1"), ("2019", "08", "001", "7.0", "89.0", "-999999999")], "year string, state string, county string, dp02_0066_pct string, dp02_0067_pct string, domestic_in_migration_rate string")
    meta = spark.createDataFrame([(2018, "dp02_0066_pct", "high_school_pct"), (2019, "dp02_0066_pct", "graduate_degree_pct"), (2018, "dp02_0067_pct", "bachelors_pct"), (2019, "dp02_0067_pct", "high_school_pct")], "year int, raw_column string, feature_name string")
    got = {r["year"]: (r["high_school_pct"], r["bachelors_pct"], r["graduate_degree_pct"]) for r in marts.survey_mart({"t": df}, meta).collect()}
    assert got == {2018: ("87.0", "20.0", None), 2019: ("89.0", None, "7.0")}


def test_income_and_employment(spark):
    inc = spark.createDataFrame([("12077", "20", "077", "Liberty County, FL", "2023", "0100", "8000", "0"), ("12077", "20", "077", "Liberty County, FL", "2023", "0010", "5", "1")], "IBRC_GEO_ID string, Statefips string, Countyfips string, Description string, Year string, Linecode string, Data string, Disclosure string")
    (r,) = marts.income_annual(inc).collect()
    assert (r["fips"], r["state_fips"], r["population"], r["personal_income_thousands"]) == ("12077", "12", 8000.0, None)
    emp = spark.createDataFrame([("12077", "077", "2024", "0", c, "10", "1,000") for c in ("00", "72")], "IBRC_GEO_ID string, Countyfips string, Year string, `Ownership Code` string, `NAICS Code` string, Employment string, `Average Wage` string")
    assert [x["avg_annual_wage_dollars"] for x in marts.employment_annual(emp).collect()] == [1000.0]


def test_name_resolution(spark):
    ref = spark.createDataFrame([("24005", "MD", "Baltimore County"), ("24510", "MD", "Baltimore City")], "fips string, state string, county_name string")
    names = spark.createDataFrame([("Baltimore County, MD", "MD"), ("Baltimore City County, MD", "MD"), ("Nowhere, MD", "MD")], "region string, state_code string")
    assert {r["region"]: r["fips"] for r in marts.resolve_counties(names, ref).collect()} == {"Baltimore County, MD": "24005", "Baltimore City County, MD": "24510"}


def test_zone_mapping(spark):
    ref = spark.createDataFrame([("01", "01077", "Lauderdale County"), ("01", "01003", "Baldwin County")], "state_fips string, fips string, county_name string")
    zones = spark.createDataFrame([("01", 1, "LAUDERDALE"), ("01", 2, "NORTHERN BALDWIN"), ("01", 3, "OPEN WATERS"), ("01", 4, "BALDWIN AND LAUDERDALE")], "state_fips string, cz_fips int, cz_name string")
    got = {(r["cz_name"], r["method"], r["fips"]) for r in marts.zone_counties(zones, ref).collect()}
    assert got == {("LAUDERDALE", "exact_county_name", "01077"), ("NORTHERN BALDWIN", "directional_or_coastal_prefix_stripped", "01003"), ("OPEN WATERS", "unmapped", ""), ("BALDWIN AND LAUDERDALE", "multi_county_phrase", "01077"), ("BALDWIN AND LAUDERDALE", "multi_county_phrase", "01003")}


def test_storm_mart(spark):
    ref = spark.createDataFrame([("01", "01077", "Lauderdale County"), ("01", "01003", "Baldwin County")], "state_fips string, fips string, county_name string")
    zones = spark.createDataFrame([("01", 9, "01003"), ("01", 9, "01077")], "state_fips string, cz_fips int, fips string")
    cols = "event_id string, episode_id string, state_fips string, cz_type string, cz_fips int, cz_name string, begin_date_time string, end_date_time string, damage_property string, damage_crops string"
    t = "24-APR-16 18:30:00"
    storms = spark.createDataFrame([("1", "7", "1", "C", 77, "X", t, t, "1K", ""), ("2", "7", "1", "C", 500, "BALDWIN", t, t, "1K", "1K"), ("3", "7", "1", "Z", 9, "Z", t, t, "2M", None)], cols)
    got = {(r["event_id"], r["fips"], r["resolution"], r["damage"]) for r in marts.storm_mart(storms, ref, zones).collect()}
    assert got == {("1", "01077", "fips", 1e3), ("2", "01003", "unique_name", 2e3), ("3", "01003", "zone", 2e6), ("3", "01077", "zone", 2e6)}


def test_insurance_arrays(spark):
    s = "fips string, insurance_premiums_14_to_24 struct<historical: struct<years: array<int>, mean: array<double>, median: array<double>>, averages: struct<mean: double, median: double, start_year: int, end_year: int>, latest: struct<year: int, mean: double, median: double>, growth_rates: struct<mean_cagr: double, median_cagr: double>>"
    df = spark.createDataFrame([("1001", (([2014, 2015], [1.0, 2.0], [1.5]), (1.5, 1.5, 2014, 2015), (2015, 2.0, 2.0), (0.1, 0.1))), ("1003", None)], s)
    assert {(r["fips"], r["year"], r["premium_mean"], r["premium_median"]) for r in marts.insurance_annual(df).collect()} == {("01001", 2014, 1.0, 1.5), ("01001", 2015, 2.0, None)}


def test_features(spark):
    util = {c: (10.0 if i == 0 else 0.0) for k in marts.BIN_SETS for i, c in enumerate(marts.bins(k))}
    cols = ["fips", "year", "median_household_income", "median_home_value", "median_gross_rent", "owner_mortgage_cost_burden_30pct_plus", "owner_mortgage_households", "burden_30_to_34_pct", "burden_35_plus_pct", *util]
    a = spark.createDataFrame([("01001", 2020, "50000", "1", "1", "30", "0", "5", "6", *map(str, util.values()))], ", ".join(f"`{c}` {'int' if c == 'year' else 'string'}" for c in cols))
    e = spark.createDataFrame([("01003", 2020, "40000", "4.0")], "fips string, year int, dp03_median_household_income string, unemployment_rate_pct string")
    b = spark.createDataFrame([("01001", 2020, 10.0, 5.0, 100.0)], "fips string, year int, net_earnings_by_place_of_residence_thousands double, transfer_receipts_thousands double, population double")
    w = spark.createDataFrame([("01001", 2020, 55.0)], "fips string, year int, avg_annual_wage_dollars double")
    got = {r["fips"]: r for r in marts.economic_features(a, e, b, w).collect()}
    r = got["01001"]
    assert r["utilities_annual_usd"] == (25 + 12.5) * 12 + 62.5 + 125 and r["owner_cost_burden_30pct_plus_pct"] == 11.0 and r["net_earnings_per_capita_usd"] == 100.0
    assert r["has_bea_income"] and not r["has_acs_economic"] and got["01003"]["median_household_income_usd"] == 40_000.0
    nri = spark.createDataFrame([("1001", "v1", "10", "Relatively Low"), ("1001", "v2", "x", "Very High")], "fips string, nri_version string, risk_score string, risk_rating string")
    assert tuple(marts.risk_features(nri).first()) == ("01001", "v2", None, "Very High", "Very High")


def test_current_counties_and_search(spark):
    df = spark.createDataFrame([(f,) for f in ("06037", "11001", "06000", "72001", "09001", "99137")], "fips string")
    keep = spark.createDataFrame([(f,) for f in ("06037", "11001", "72001", "09003")], "fips string")
    assert {r[0] for r in marts.current_counties(df, keep, keep).collect()} == {"06037", "11001"}
    assert marts.search(df, "1", ["fips"]).count() == 0 and marts.search(df, "110", ["fips"]).count() == 1


def test_catalog(spark):
    got = {r["feature_name"]: r["retained"] for r in feature_catalog(spark).collect()}
    assert all(got[f] for f in ("extreme_event_count", "homeowners_insurance_pct_income", "property_taxes_pct_income", "utilities_pct_income", "earnings_by_place_of_work_per_capita_usd", "dividends_interest_rent_per_capita_usd", "transfer_receipts_per_capita_usd"))
    assert not any(got[f] for f in ("fema_event_count", "risk_rating", "risk_score", "median_home_value_usd", "price_drops_yoy", "housing_cost_pct_income", "per_capita_personal_income_usd", "net_earnings_per_capita_usd"))


def test_keys_and_profiles(spark):
    with pytest.raises(ValueError):
        relational.assert_unique_key(spark.createDataFrame([(None,), (None,)], "k int"), ["k"])
    df = spark.createDataFrame([(1.0, "1", 1.0), (2.0, "2", 1.0), (3.0, None, 2.0)], "a double, b string, c double")
    assert quality.duplicate_columns(df.withColumn("d", F.col("a")), [("a", "d"), ("a", "c")], 1) == ["d"]
    m = {r["column_name"]: r["nulls"] for r in quality.missingness(df, ["a", "b"]).collect()}
    assert m == {"a": 0, "b": 1}


def test_rings(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]],)], "r array<array<double>>")
    area, turned = df.select(geo.signed_area(F.col("r")), geo.oriented(F.col("r"))).first()
    assert area == 1.0 and turned[1] == [0.0, 1.0]


def test_rules_of_names():
    assert text.raw_variable_column("B25132_C01_003PM") == "b25132_c01_003_pct_moe" and text.variable_of_column("b25132_c01_003_pct_moe") == "B25132_C01_003PM"
    for name in ("DP03_0062", "dp03_0062PE", "DP03_0062PX", "DP_0062PE", "03_0062PE", "DP03_C1_2_0062E", "NAME", ""):
        assert text.raw_variable_column(name) == name
    for name in ("dp03_0062", "DP03_0062_pct", "dp03_pct", "dp03_0062_share", "pct"):
        assert text.variable_of_column(name) is None
    assert clean.measure_never_negative("value") and not clean.measure_never_negative("value", "ncei_climate_at_a_glance_county_monthly")


def test_a_table_keeps_its_rows_if_the_swap_fails(spark):
    from loomstead.sources.sinks import swap_table

    name = "default.swap_kept"
    for n in (3, 4):
        assert swap_table(spark.range(n), name).count() == n
    assert swap_table(spark.table(name).filter("id < 2"), name).count() == 2 and not spark.catalog.tableExists(f"{name}__old")
    spark.sql(f"DROP TABLE {name}")


def test_canonical_events_are_met_in_buckets(spark):
    """Long, inverted and neighbouring periods meet as by a plain join of all."""
    rng = random.Random(8)
    base = dt.datetime(2020, 1, 1)

    def some(n):
        out = []
        for i in range(n):
            s = base + dt.timedelta(days=rng.randint(0, 200))
            out.append(("x", str(i), "01001", "Flood", rng.choice(["Flood", "Wildfire"]), s, s + dt.timedelta(days=rng.choice([-3, 0, 2, 90])), float(i), str(i)))
        return out

    schema = "event_source string, source_event_id string, fips string, event_type string, event_name string, event_start timestamp_ntz, event_end timestamp_ntz, total_damage_amount double, episode_id string"
    a, b = some(25), some(40)
    out = events.canonical_events(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).filter("has_fema and has_noaa").collect()
    got = {(k.split(":")[1]) for r in out for k in r["associated_source_event_keys"].split("|") if k.startswith("noaa:")}
    slack = dt.timedelta(days=events.MATCH_DAYS)
    assert got == {y[1] for y in b if any(x[4] == y[4] and x[5] <= y[6] + slack and x[6] >= y[5] - slack for x in a)}


def test_alike_groups_meet_the_panel_once(spark, monkeypatch):
    """Groups of the same units and months are joined with the panel as one, and each has its rows."""
    month = lambda i: dt.date(2020 + i // 12, i % 12 + 1, 1)
    panel = spark.createDataFrame([(u, "r", month(i), float(100 * "abc".index(u) + i)) for u in "abc" for i in range(12)], "unit string, region string, period date, x double")
    alike = [("a", "s", f"e{k}", month(4), month(5)) for k in range(50)]
    events = spark.createDataFrame([*alike, alike[0], *[(u, "s", "both", month(4), month(5)) for u in "ab"], ("a", "s", "late", month(11), month(11))], "unit string, event_source string, source_event_id string, event_start_month date, event_end_month date")
    met, inner = [], windows._baselines
    monkeypatch.setattr(windows, "_baselines", lambda ev, *a: met.append(ev.select("event_group").distinct().count()) or inner(ev, *a))
    out = windows.baseline_windows(events, panel, "unit", "region", "period", ["x"], 1, 1).collect()
    assert met == [3]
    rows = {(r["event_group"].split("|")[1], r["status"], r["event_window_month"]): (r["median"], r["county_count"]) for r in out}
    at = {-1: 3, 0: 4, 1: 6}
    want = {(f"e{k}", "affected", m): (float(i), 1) for k in range(50) for m, i in at.items()} | {(f"e{k}", "baseline", m): (150.0 + i, 1) for k in range(50) for m, i in at.items()}
    want |= {("both", "affected", m): (50.0 + i, 2) for m, i in at.items()} | {("both", "baseline", m): (200.0 + i, 2) for m, i in at.items()}
    assert rows == want and len(out) == len(want)


def test_alike_lines_are_summed_up_by_weight(spark):
    """One line stands for all of equal events; the summary is that of all lines one by one."""
    month = lambda i: dt.date(2020 + i // 12, i % 12 + 1, 1)
    panel = spark.createDataFrame([(u, month(i), float((7 * i + 31 * "abc".index(u)) % 50) if (u, i) != ("b", 20) else None) for u in "abc" for i in range(40)], "unit string, period date, x double")
    data = [(k, u, r, month(s), month(s + 1)) for k, (u, r, s) in enumerate([("a", "Low", 14)] * 30 + [("b", "High", 14)] * 5 + [("c", None, 15)] * 7 + [("a", "Low", 16)] * 2)]
    ev = spark.createDataFrame([*data, (None, "a", "Low", month(14), month(15))], "key long, unit string, rating string, event_start_month date, event_end_month date")
    lines = windows.alike_lines(ev, "key", "lines")
    assert sorted((r["key"], r["lines"], r["unit"]) for r in lines.collect()) == [(0, 30, "a"), (30, 5, "b"), (35, 7, "c"), (42, 2, "a")]
    of = lambda df, **kw: {tuple(r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in sorted(r.asDict())) for r in windows.window_summary(windows.event_windows(df, panel, "unit", "period", 12, 12), "key", "unit", "rating", ["x"], (6, 12), **kw).collect()}
    weighed, single = of(lines, weight="lines"), of(ev.filter("key is not null"))
    assert weighed == single and len(single) > 80
