"""Filling, intervals, profiles, drift and rejects against brute force and on awkward input."""

import datetime as dt
import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstead.functions.eventkeys import fips5, source_keys, with_identity, with_key_parts
from loomstead.operators.imputation import propagate_categories, propagate_numbers
from loomstead.operators.intervals import continuous_periods, interval_gaps
from loomstead.operators.profile import LARGEST, ColumnRule, merge_sums, power_sums, profile_loads, range_quantiles, unusual_loads
from loomstead.operators.skew import sharded_neighbour, skew_join
from loomstead.sources import drift, treeedit
from loomstead.sources.rejects import INCOME_LINES, load_strict, reject_reasons


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_event_keys_in_any_spelling(spark):
    df = spark.createDataFrame(
        [(1, "fema:3000:01043:2018-06-01"), (2, "Fema : 3000 : 1043 : 2018-06-01"), (3, " FEMA:3000:01043:2018-06-01 00:00:00 "), (4, None), (5, "nonsense"), (6, "")], "id int, k string"
    )
    got = {r["id"]: (r["source"], r["source_id"], r["county"], r["month"]) for r in with_key_parts(df, "k").collect()}
    want = ("fema", "3000", "01043", "2018-06-01")
    assert got[1] == got[2] == got[3] == want
    assert got[4] == got[5] == got[6] == (None,) * 4


def test_identity_from_columns(spark):
    df = spark.createDataFrame(
        [(1, None, "noaa", "7", " 1001 ", dt.date(2020, 1, 1)), (2, None, "noaa", "7", None, dt.date(2020, 1, 1))],
        "id int, event_key string, event_source string, source_event_id string, fips string, event_start_month date",
    )
    got = {r["id"]: r["county"] for r in with_identity(df).collect()}
    assert got == {1: "01001", 2: None}


def test_source_keys(spark):
    df = spark.createDataFrame([("fema: 1|NOAA:2|",), ("noaa:2, fema:1;fema:1",), ("||",), (None,)], "k string")
    assert [sorted(r[0]) for r in df.select(source_keys("k")).collect()] == [["fema:1", "noaa:2"], ["fema:1", "noaa:2"], [], []]


def test_fips5(spark):
    df = spark.createDataFrame([("1001",), (" 01001 ",), ("x",), (None,), ("",)], "f string")
    assert [r[0] for r in df.select(fips5("f")).collect()] == ["01001", "01001", None, None, None]


@pytest.mark.parametrize("lead", [False, True])
def test_sharded_neighbour(spark, lead):
    rng = random.Random(3)
    data = [(rng.choice("ab"), t // 7, t, t * 10) for t in rng.sample(range(100), 60)]
    got = {(r["e"], r["t"]): r["next_v" if lead else "prev_v"] for r in sharded_neighbour(spark.createDataFrame(data, "e string, s int, t int, v int"), ["e"], "s", ["t"], ["v"], lead).collect()}
    for e in "ab":
        ts = sorted(t for x, _, t, _ in data if x == e)
        for i, t in enumerate(ts):
            j = i + 1 if lead else i - 1
            assert got[(e, t)] == (ts[j] * 10 if 0 <= j < len(ts) else None)


def test_skew_join_keeps_all_rows_of_a_hot_key(spark):
    left = spark.range(9000).withColumn("k", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")))
    look = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    out = skew_join(left, look, ["k"], "n", ["id"])
    assert out.count() == 9000 and out.filter("m is null").count() == 0


def test_fill_matches_brute_force(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        v = rng.choice([None, float("nan"), -888888888.0, *[float(rng.randint(1, 50))] * 4])
        data.append((i, rng.choice([1, 2]), rng.choice([None, "01001", "01003", "02001", "09009"]), rng.choice([1, 2, 3]), v))
    df = spark.createDataFrame(data, "row_id int, load int, county string, month int, x double").withColumn("state", F.substring("county", 1, 2)).withColumn("column_name", F.lit("clash"))
    out = propagate_numbers(df, "row_id", ["x"], [["load", "county"], ["load", "state", "month"]]).collect()
    good = lambda v: v is not None and v == v and v > -1e8
    missing = [d for d in data if not good(d[4])]
    assert {r["row_id"] for r in out} == {d[0] for d in missing}
    for r in out:
        d = data[r["row_id"]]
        near = [e for e in data if e[1] == d[1] and good(e[4]) and d[2] and e[2] and (e[2] == d[2] or (e[2][:2] == d[2][:2] and e[3] == d[3]))]
        assert (r["hops"] == 1) == bool(near)
        assert r["filled"] == (r["value"] is not None)


def test_fill_of_empty_table(spark):
    assert propagate_numbers(spark.createDataFrame([], "row_id int, g int, x double"), "row_id", ["x"], [["g"]]).count() == 0


def test_fill_value_is_mean_of_hubs(spark):
    df = spark.createDataFrame([(1, "a", "p", 10.0), (2, "a", "q", 20.0), (3, "b", "p", 40.0), (4, "a", "p", None)], "row_id int, g string, h string, x double")
    (r,) = propagate_numbers(df, "row_id", ["x"], [["g"], ["h"]], rounds=1).collect()
    assert r["value"] == pytest.approx((15.0 + 25.0) / 2)


def test_categories(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "a", None), (5, "b", " "), (6, None, None)], "row_id int, g string, c string")
    assert rows(propagate_categories(df, "row_id", "c", [["g"]]), "row_id", "value", "hops") == {(4, "x", 1)}


def test_categories_of_housing_rows(spark, tmp_path):
    from loomstead.plans.hygiene import p2_categories

    data = [
        (1, 1, "01001", "A", "AL", "2020-01-01"), (2, 1, " 1001", None, "AL", "2020-02-01"), (3, 1, "01001", "A", " ", "2020-01-01"),
        (4, 1, "01003", None, None, "2020-01-01"),   # its county says nothing, its state and month do
        (5, 2, "01001", None, "AL", "2020-01-01"),   # loads are not mixed
        (6, 1, "01003", "", "AL", "2020-05-01"),     # reached by way of row 4
    ]
    spark.createDataFrame(data, "row_id long, load_id int, fips string, county_name string, state_code string, housing_month string").write.parquet(str(tmp_path / "county_housing_monthly.parquet"))
    got = rows(p2_categories(spark, str(tmp_path)), "row_id", "column_name", "value", "filled", "hops")
    assert got == {
        (2, "county_name", "A", True, 1), (4, "county_name", "A", True, 1), (5, "county_name", None, False, None), (6, "county_name", "A", True, 2),
        (3, "state_code", "AL", True, 1), (4, "state_code", "AL", True, 1),
    }


def brute_intervals(data):
    gaps, periods = set(), set()
    for k in {d[0] for d in data if d[0] is not None}:
        own = sorted((s, s if e is None else e) for x, s, e in data if x == k and s is not None and (e is None or e >= s))
        cur = None
        for s, e in own:
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    gaps.add((k, cur[1], s)), periods.add((k, *cur))
                cur = [s, e]
        if cur:
            periods.add((k, *cur))
    return gaps, periods


@pytest.mark.parametrize("seed", range(3))
def test_intervals_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2020, 1, 1)
    data = []
    for _ in range(150):
        s = base + dt.timedelta(hours=rng.randint(0, 9000) // 24 * 24)
        e = rng.choice([None, s, s - dt.timedelta(hours=1), s + dt.timedelta(hours=rng.choice([1, 24, 48, 2000]))])
        data.append((rng.choice(["a", "b", None]), rng.choice([s, s, s, None]), e))
    df = spark.createDataFrame(data, "k string, s timestamp_ntz, e timestamp_ntz").withColumn("shard", F.lit("clash"))
    gaps, periods = brute_intervals(data)
    assert rows(interval_gaps(df, ["k"], "s", "e", 8), "k", "gap_start", "gap_end") == gaps
    assert rows(continuous_periods(df, ["k"], "s", "e", 8), "k", "period_start", "period_end") == periods


def test_profile_finds_the_odd_loads(spark):
    data = []
    for load in range(1, 9):
        for i in range(60):
            text = f"{50_000 + i * 10 + load:,}"
            if load == 2 and i < 20:
                text = random.Random(i).choice([None, " ", ""])
            if load == 3 and i < 12:
                text = "5l,200"
            if load == 4:
                text = str(90_000 + i)
            if load == 5:
                text = "50,100"
            data.append((load, text))
    data += [(9, None)] * 3
    df = spark.createDataFrame(data, "load_id int, income string")
    p = profile_loads({"t": df}, [ColumnRule("t", "income", 5_000, 400_000)])
    got = {r["load_id"]: r["why"] for r in unusual_loads(p).collect()}
    assert got == {2: "missing", 3: "bad", 4: "median", 5: "distinct", 9: "missing|median"}
    one = {r["load_id"]: r for r in p.collect()}
    assert one[4]["median"] == 90_029.5 and one[4]["distinct_values"] == 60 and one[9]["good"] == 0


def test_a_null_load_is_a_load_of_its_own(spark):
    data = [(load, float(v)) for load in (1, 2, None) for v in range(100, 160)]
    p = profile_loads({"t": spark.createDataFrame(data, "load_id int, x double")}, [ColumnRule("t", "x", 0, 1_000)])
    assert [r["median"] for r in p.collect()] == [129.5] * 3
    assert unusual_loads(p, shift_above=0.1).count() == 0


def test_shifted_means_are_flagged(spark):
    data = [(load, float(v + (40 if load == 3 else 0))) for load in (1, 2, 3, 4) for v in range(500, 560)]
    p = profile_loads({"t": spark.createDataFrame(data, "load_id int, x double")}, [ColumnRule("t", "x", 0, 1_000)])
    assert [(r["load_id"], r["why"]) for r in unusual_loads(p, shift_above=1.0).collect()] == [(3, "shift")]
    assert unusual_loads(p).count() == 0


def test_power_sums_merge_to_the_same_digits(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.randint(-LARGEST, LARGEST), rng.randint(1, 9), i) for i in range(400)] + [("a", None, 3, 0), ("b", LARGEST, 10**9, 1)]
    df = spark.createDataFrame(data, "k string, y long, n long, i int")
    whole = {r["k"]: r for r in power_sums(df, ["k"], "y", "n").collect()}
    for k, r in whole.items():
        s = [sum(n * y**p for kk, y, n, _ in data if kk == k and y is not None) for p in range(5)]
        assert (int(r["s0"]), int(r["s1"]), int(r["s2"]), int(r["s3_high"]) * 2**30 + int(r["s3_low"])) == tuple(s[:4])
        assert int(r["s4_high"]) * 2**60 + int(r["s4_mid"]) * 2**31 + int(r["s4_low"]) == s[4]
    parts = [power_sums(df.filter(f"pmod(i, 3) = {j}"), ["k"], "y", "n") for j in (2, 0, 1)]
    assert {r["k"]: r for r in merge_sums(parts[0].union(parts[1]).union(parts[2]), ["k"]).collect()} == whole


def test_moments_do_not_cancel(spark):
    data = [(1, 1e7 - v) for v in (0.01, 0.02, 0.04, 0.01)]
    r = profile_loads({"t": spark.createDataFrame(data, "load_id int, x double")}, [ColumnRule("t", "x", 0, 1e7)]).first()
    assert abs(r["mean"] - (1e7 - 0.02)) < 1e-8 and abs(r["stddev"] ** 2 - 1.5e-4) < 1e-15 and r["skewness"] < 0


@pytest.mark.parametrize("seed", range(2))
def test_range_quantiles_are_exact(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.uniform(-5, 5), rng.randint(-3, 3) * 1e6, 0.0]), rng.randint(1, 4)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, x double, n int")
    at = {"low": 0.0, "q1": 0.25, "q9": 0.9, "high": 1.0}
    got = {r["k"]: r for r in range_quantiles(df, ["k"], "x", "n", at).collect()}
    assert set(got) == {k for k, x, _ in data if x is not None}
    for k, r in got.items():
        xs = sorted(x for kk, x, n in data for _ in range(n) if kk == k and x is not None)
        for c, q in at.items():
            p = q * (len(xs) - 1)
            lo, hi = xs[int(p)], xs[min(int(p) + (p > int(p)), len(xs) - 1)]
            assert abs(r[c] - (lo + (hi - lo) * (p - int(p)))) < 1e-9 * max(1, abs(lo))


def test_profile_of_empty_table(spark):
    p = profile_loads({"t": spark.createDataFrame([], "load_id int, x double")}, [ColumnRule("t", "x", 0, 1)])
    assert p.count() == 0 and unusual_loads(p).count() == 0


def series(spark, files):
    data = [(fid, 1, seq, i, p if p is None or isinstance(p, str) else json.dumps(p)) for fid, seq, payloads in files for i, p in enumerate(payloads)]
    return spark.createDataFrame(data, "file_id long, series_id long, file_seq int, row_no int, payload string")


def test_schema_changes(spark):
    df = series(spark, [
        (10, 1, [{"year": "2013", "dp02_0066_pct": 1.5, "state": "01"}, {"year": "2013", "note": None}]),
        (7, 2, [{"Year": "2014", "DP02_0066PE": "2.0", "state": None, "x": {"a": 1, "b": 2}}]),
        (9, 3, [{"Year": 2015, "DP02_0066PE": "2.0", "statefp": "1", "x": {"a": 1}, "b": 2}, None, "no json", "[1]"]),
        (3, 4, []),
        (4, 5, [{"Year": 2016}]),
    ])
    got = rows(drift.schema_changes(df, "series_id", "file_seq", "file_id", "payload"), "file_id", "field_name", "change_kind")
    assert {g for g in got if g[0] == 7} == {(7, "Year", "renamed"), (7, "DP02_0066PE", "renamed"), (7, "DP02_0066PE", "retyped"), (7, "note", "removed"), (7, "x.a", "added"), (7, "x.b", "added"), (7, "x", "added")}
    assert {g for g in got if g[0] == 9} == {(9, "Year", "retyped"), (9, "statefp", "renamed"), (9, "b", "moved")}
    assert (4, "DP02_0066PE", "removed") in got


def leaves(**fields):
    return treeedit.field_tree((k, "number" if isinstance(v[0], (int, float)) else "text", ",".join(f"{s}:{n}" for s, n in Counter(map(treeedit.spot, v)).items())) for k, v in fields.items())


def test_scripts_are_of_least_cost():
    old = leaves(dp02_0066_pct=["21.6%", "33.0", "52"], dp02_0066_moe=[7.0, 55.2, 12.5], area_1=[3, 4], gone=["x", "y"])
    new = leaves(DP02_0066PM=[7.1, 54, 12], dp02_0066_share=[21, 33.4, 52.8], area_2=[3, 4], came=[1_000_000, 5])
    cost, script = treeedit.edit_script(old, new)
    assert {s for s in script if s[0] == "renamed"} == {("renamed", "DP02_0066PM", "dp02_0066_moe"), ("renamed", "dp02_0066_share", "dp02_0066_pct")}
    assert ("retyped", "dp02_0066_share", "dp02_0066_pct") in script and ("removed", "area_1", "area_1") in script and ("added", "came", None) in script
    least = min(  # brute force over all ways to match the four fields
        sum(treeedit.HALF if j is None else treeedit._relabel(a, b) for a, j in zip(old.kids.values(), pick) for b in [j and new.kids[j]])
        + treeedit.HALF * (len(new.kids) - sum(j is not None for j in pick))
        for pick in itertools.product([None, *new.kids], repeat=4) if len([j for j in pick if j]) == len({j for j in pick if j})
    )
    assert abs(cost - least) < 1e-9


def test_names_side_by_side_are_two_fields(spark):
    files = [(1, 1, [{"rate": 5, "year": 2013}]), (2, 2, [{"rate_b": 5, "year": 2013}]), (3, 3, [{"rate": 7, "rate_b": 5, "year": 2014}])]
    changes = lambda fs: rows(drift.schema_changes(series(spark, fs), "series_id", "file_seq", "file_id", "payload"), "file_id", "field_name", "change_kind")
    assert changes(files[:2]) == {(2, "rate_b", "renamed")}
    assert changes(files) == {(2, "rate_b", "added"), (2, "rate", "removed"), (3, "rate", "added")}


def test_assignment_is_of_least_cost():
    rng = random.Random(5)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 6)):
        cost = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = treeedit.assign(cost)
        assert len(set(got)) == n
        assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_unified_table(spark):
    df = series(spark, [(1, 1, [{"YEAR": 2013, "dp02_0066pe": " 21.6%"}, None, "no json"]), (2, 2, [{"acs_year": "2014", "dp02_0066_pct": 20}])])
    wanted = {"year": lambda c: c.try_cast("int"), "dp02_0066_pct": drift.number_text}
    out = drift.series_table(df, ["file_id", "row_no"], "series_id", "file_seq", "file_id", "payload", wanted, lambda c: lambda v: v)
    assert out.columns == ["file_id", "row_no", "year", "dp02_0066_pct"]
    assert rows(out, *out.columns) == {(1, 0, 2013, 21.6), (1, 1, None, None), (1, 2, None, None), (2, 0, 2014, 20.0)}


def test_table_of_all_files_follows_the_scripts(spark, tmp_path):
    from loomstead.plans.hygiene import p6_table

    files = [
        (10, 1, [{"year": "2013", "dp02_0088_pct": "3.50%", "x": {"b": 1, "c": 7}, "old": {"p": {"note": "n"}}, "tags": [1.25, {"k": "v"}]}, None, "[1]"]),
        (7, 2, [{"Year": 2014, "DP02_0088PE": 4, "B": 2, "X": {"c": 8}, "mid": {"note": "m"}}]),
        (9, 3, [{"survey_year": "2015", "B": 3, "note": "l", "row_no": 5}]),
        (4, 4, [{"year": 2016, "x": {"b": 4, "b2": 5}}]),
    ]
    series(spark, files).write.parquet(str(tmp_path / "census_acs5_county_dp02_test.parquet"))
    out = p6_table(spark, str(tmp_path))
    got = {(r["file_id"], r["row_no"]): {k: v for k, v in r.asDict().items() if v is not None and k not in ("series_id", "file_id", "file_seq", "row_no")} for r in out.collect()}
    assert got == {
        (10, 0): {"year": 2013, "dp02_0088_pct": 3.5, "x.b": "1", "x.c": "7", "note": "n", "tags": '[1.25,{"k":"v"}]'}, (10, 1): {}, (10, 2): {},
        (7, 0): {"year": 2014, "dp02_0088_pct": 4.0, "x.b": "2", "x.c": "8", "note": "m"},
        (9, 0): {"year": 2015, "x.b": "3", "note": "l", "payload_row_no": "5"},
        (4, 0): {"year": 2016, "x.b": "4", "x.b2": "5"},
    }


def test_a_move_does_not_merge_two_fields_of_a_file(spark):
    df = series(spark, [(1, 1, [{"b": 1, "x": {"b": 2}}]), (2, 2, [{"x": {"b": 3}}]), (3, 3, [{"b": 4}])])
    out = drift.series_table(df, ["file_id"], "series_id", "file_seq", "file_id", "payload", {}, lambda c: lambda v: v)
    assert rows(out.select("file_id", "b", F.col("`x.b`").alias("xb")), "file_id", "b", "xb") == {(1, "1", "2"), (2, "3", None), (3, "4", None)}


LINES = {
    1: ('1,01,001,"A County, AL",2013,0050,308290,0', None),
    2: ('1,01,001,"A ""Old"" County, AL",2013,0050, -1.5E3 ,0\r', None),
    3: ('1,01,001,"A\nCounty, AL",2013,0050,(D),1', None),
    4: ('1,01,001,"A "Old" County",2013,0050,1,0', "quoting"),
    5: ('1,01,001,"A County, AL,2013,0050,1,0', "quoting"),
    6: ('1,01,001,A "x",2013,0050,1,0', "quoting"),
    7: ("1,01,001,A,2013,0050,1", "column_count"),
    8: (",1,01,001,A,2013,0050,1,0", "column_count"),
    9: ("", "column_count"),
    10: (None, "column_count"),
    11: ("1,01,001,A,2O13,0050,1,0", "invalid_value"),
    12: ("1,01,001,A,1899,0050,1,0", "invalid_value"),
    13: ('1,01,001,A,2013,0050,"3,928",0', "invalid_value"),
    14: ("1,01,001,A,2013,0050,,0", "invalid_value"),
    15: ("1,01,001,A, 2013 ,0050,,2", None),
    16: ('1,01,001,"' + "long," * 20_000 + '",2013,0050,1,0', None),
    17: ('1,01,001,"A",2013,0050,1,"0', "quoting"),
    18: ("1,01,001,A,2013,0050,1e,0", "invalid_value"),
}


def test_rejects(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in LINES.items()] + [(1, LINES[1][0], "clash")], "line_id long, line string, reason string")
    got = {r["line_id"]: r["reason"] for r in reject_reasons(df, ["line_id"], "line", INCOME_LINES).collect()}
    assert got == {i: w for i, (_, w) in LINES.items() if w}
    kept = load_strict(df, "line", INCOME_LINES)
    assert {r["line_id"] for r in kept.collect()} == {i for i, (_, w) in LINES.items() if not w}
    assert kept.filter("line_id = 2").first()["Description"] == 'A "Old" County, AL'


def test_rejects_of_empty_table(spark):
    df = spark.createDataFrame([], "line_id long, line string")
    assert reject_reasons(df, ["line_id"], "line", INCOME_LINES).count() == 0 == load_strict(df, "line", INCOME_LINES).count()
