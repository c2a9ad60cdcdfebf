"""Event-study queries over the star schema: nations are units, regions their states, orders of great value events."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators import playbook, stats, windows
from loomstead.operators.events import latest_complete_year
from loomstead.operators.relational import complete_members, complete_only, dense_series, latest_years
from loomstead.plans.tables import table

RATINGS = ("Very Low", "Low", "Medium", "High", "Very High")
DIGITS = 6
Events = Callable[[SparkSession, str], DataFrame]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


def rating(c: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in RATINGS]), (F.col(c) % 5 + 1).cast("int"))


def located_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the nation and region of their customer."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")  # a fixed list of nations
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    return orders.join(customer, "o_custkey").join(nation, "n_nationkey").withColumnsRenamed({"n_nationkey": "unit", "n_regionkey": "region"})


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(unit, region, period, median_price, orders_n, mean_price): one row per nation and month."""
    rows = located_orders(spark, sf).withColumn("period", F.trunc("day", "month"))
    return rows.groupBy("unit", "region", "period").agg(F.median("o_totalprice").alias("median_price"), F.count(F.lit(1)).alias("orders_n"), F.avg("o_totalprice").alias("mean_price"))


def _as_events(rows: DataFrame) -> DataFrame:
    end = F.date_add("day", (F.col("o_orderkey") % 90).cast("int"))
    return rows.select(
        F.col("o_orderkey").alias("event_key"), "unit", rating("unit").alias("risk_rating"), F.lit("orders").alias("event_source"), F.col("o_orderkey").cast("string").alias("source_event_id"),
        F.trunc("day", "month").alias("event_start_month"), F.trunc(end, "month").alias("event_end_month"),
    )


def all_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All located orders as events of orderkey mod 90 days."""
    return _as_events(located_orders(spark, sf))


def great_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders from the 99th percentile on, as events of orderkey mod 90 days; the events of the queries with SQL."""
    cap = table(spark, sf, "orders").agg(F.percentile("o_totalprice", F.lit(0.99)).alias("cap"))
    return _as_events(located_orders(spark, sf).crossJoin(F.broadcast(cap)).filter("o_totalprice >= cap"))


def over_all_orders(*queries: Callable[..., DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query once more, over all located orders as events."""
    return {f"{f.__name__}_all_orders": partial(f, events=all_orders) for f in queries}


def _windows(spark: SparkSession, sf: str, post: int, events: Events) -> DataFrame:
    return windows.event_windows(events(spark, sf), panel(spark, sf), "unit", "period", windows.PRE, post)


def event_window_quartiles(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    return stats.quartiles(_windows(spark, sf, 12, events), ["risk_rating", "event_window_month"], "median_price")


def complete_window_summary(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    ev = events(spark, sf).select("event_key", "unit", "risk_rating", "event_start_month", "event_end_month")
    rows = windows.event_windows(windows.alike_lines(ev, "event_key", "lines"), panel(spark, sf), "unit", "period", windows.PRE, 36)
    out = windows.window_summary(rows, "event_key", "unit", "risk_rating", ["median_price", "orders_n"], (12, 24, 36), ratings=RATINGS, weight="lines")
    return out.withColumns({c: r6(c) for c in ("q25", "median", "q75", "mean")})


def complete_line_filter(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    return complete_members(_windows(spark, sf, 36, events), ["event_key"], "event_window_month", size=49, value="median_price")


def event_phase_counts(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    return _windows(spark, sf, 24, events).groupBy("event_window_phase").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_key").alias("n_events"), F.min("months_from_event_start").alias("first_month"), F.max("months_after_event_end").alias("last_month"))


def state_month_baseline(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    out = windows.baseline_windows(events(spark, sf), panel(spark, sf), "unit", "region", "period", ["median_price"], 12, 12, DIGITS)
    return out.select("event_group", "event_window_month", "metric_name", "status", "median", "county_count", "event_window_phase")


def latest_complete_year_window(spark: SparkSession, sf: str) -> DataFrame:
    return latest_complete_year(panel(spark, sf), "period")


def median_of_medians(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    return stats.median_of_medians(_windows(spark, sf, 12, events), ["unit"], ["event_key"], "median_price").select("unit", r6("target").alias("target"))


def mean_by_key(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    return _windows(spark, sf, 12, events).groupBy("unit").agg(r6(F.avg("median_price")).alias("target"), F.count(F.lit(1)).alias("n"))


def dense_month_array(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    axis = p.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("period"))
    dense = dense_series(p, ["unit"], axis, "period", "orders_n")
    return dense.select("unit", F.array_join(F.transform("series", lambda x: x.cast("string")), ",", "-").alias("series"))


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).withColumn("risk_rating", rating("unit"))


def risk_group_series(spark: SparkSession, sf: str) -> DataFrame:
    return playbook.group_series(_rated(spark, sf), "risk_rating", "period", "median_price")


def historical_assignment(spark: SparkSession, sf: str) -> DataFrame:
    h = playbook.history_statistics(_rated(spark, sf), "unit", "risk_rating", "period", "median_price")
    return h.select("unit", "risk_rating", *[r6(x).alias(x) for x in "abcd"], playbook.historical_assignment(*[F.col(x) for x in "abcd"]).alias("assignment"))


def relative_position(spark: SparkSession, sf: str) -> DataFrame:
    p = _rated(spark, sf)
    bands = stats.quartiles(p, ["risk_rating", "period"], "median_price")
    j = p.join(bands, ["risk_rating", "period"])
    return j.groupBy("unit").agg(*[F.count_if(playbook.relative_position(r6("median_price"), F.col("q1"), F.col("q3")) == x).alias(x.split()[0].lower()) for x in ("Upper range", "Mid range", "Lower range")])


def global_zscore_index(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.global_zscores(panel(spark, sf), ["median_price", "orders_n", "mean_price"], ["orders_n"], "composite")
    return out.select("unit", "period", *[r6(f"z_{c}").alias(f"z_{c}") for c in ("median_price", "orders_n", "mean_price")], r6("composite").alias("composite"))


def event_expectation(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    return playbook.event_expectation(_windows(spark, sf, 36, events), "risk_rating", "median_price", 100.0).select("risk_rating", r6("change").alias("change"), "direction")


def band_fit(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    w = _windows(spark, sf, 12, events)
    w = complete_only(w, ["event_key"], "event_window_month", 25)
    bands = stats.quartiles(w, ["risk_rating", "event_window_month"], "median_price")
    out = windows.band_fit(w, bands, "event_key", ["risk_rating", "event_window_month"], "median_price")
    return out.select("event_key", "risk_rating", "months", "eligible", *[r6(c).alias(c) for c in ("max_deviation", "mean_deviation", "median_standardised_gap", "above_median_share", "avg_metric")])


def ten_year_avg(spark: SparkSession, sf: str) -> DataFrame:
    rows = located_orders(spark, sf).withColumn("year", F.year("day"))
    return latest_years(rows, "year", 4).groupBy("unit").agg(r6(F.avg("o_totalprice")).alias("avg_price"), F.countDistinct("year").alias("years"))


def eligible_event_range(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    p = panel(spark, sf)
    bounds = p.agg(F.add_months(F.min("period"), 12).alias("lo"), F.add_months(F.max("period"), -12).alias("hi"))
    ev = events(spark, sf).crossJoin(F.broadcast(bounds)).filter("event_start_month >= lo and event_end_month <= hi")
    return ev.join(p.select("unit"), "unit", "left_semi").select("event_key", "unit", "event_start_month", "event_end_month")


QUERIES = {
    f.__name__: f
    for f in (
        event_window_quartiles, complete_window_summary, complete_line_filter, event_phase_counts, state_month_baseline, latest_complete_year_window, median_of_medians, mean_by_key,
        dense_month_array, risk_group_series, historical_assignment, relative_position, global_zscore_index, event_expectation, band_fit, ten_year_avg, eligible_event_range,
    )
}
QUERIES |= over_all_orders(
    event_window_quartiles, complete_window_summary, complete_line_filter, event_phase_counts, state_month_baseline, median_of_medians,
    mean_by_key, event_expectation, band_fit, eligible_event_range,
)

_RATING = "CASE {0} % 5 WHEN 0 THEN 'Very Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Very High' END"
_LOCATED = """located AS (
  SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, c_nationkey AS unit, n_regionkey AS region, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_PANEL = f"""{_LOCATED}, panel AS MATERIALIZED (
  SELECT unit, region, CAST(date_trunc('month', day) AS DATE) AS period, median(o_totalprice) AS median_price, count(*) AS orders_n, avg(o_totalprice) AS mean_price FROM located GROUP BY 1, 2, 3)"""
_EVENTS = f"""{_PANEL}, ev AS MATERIALIZED (
  SELECT o_orderkey AS event_key, unit, {_RATING.format('unit')} AS risk_rating, CAST(date_trunc('month', day) AS DATE) AS sm, CAST(date_trunc('month', day + CAST(o_orderkey % 90 AS INT)) AS DATE) AS em
  FROM located WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders))"""


def _win(post: int, pre: int = 12) -> str:
    diff = "((year(p.period) - year({0})) * 12 + month(p.period) - month({0}))"
    mfs, mae = diff.format("e.sm"), diff.format("e.em")
    return f"""{_EVENTS}, w AS MATERIALIZED (
  SELECT * FROM (SELECT e.*, p.region, p.period, p.median_price, p.orders_n, p.mean_price, {mfs} AS mfs, {mae} AS mae, CASE WHEN {mfs} <= 0 THEN {mfs} ELSE {mae} END AS m
  FROM ev e JOIN panel p ON p.unit = e.unit) WHERE mfs BETWEEN -{pre} AND 0 OR (mfs > 0 AND mae BETWEEN 1 AND {post}))"""


_PHASE = "CASE WHEN m <= 0 THEN '12 months before through event start' ELSE CAST(((m - 1) // 12) * 12 + 1 AS VARCHAR) || '-' || CAST(((m - 1) // 12) * 12 + 12 AS VARCHAR) || ' months after event end' END"
_MONTHLY = "med AS (SELECT risk_rating, period, quantile_cont(median_price, 0.25) AS q1, median(median_price) AS q2, quantile_cont(median_price, 0.75) AS q3 FROM rated GROUP BY 1, 2)"
_RATED = f"{_PANEL}, rated AS (SELECT *, {_RATING.format('unit')} AS risk_rating FROM panel), {_MONTHLY}"

SQL = {
    "event_window_quartiles": f"WITH {_win(12)} SELECT risk_rating, m AS event_window_month, round(quantile_cont(median_price, 0.25), 6) AS q1, round(median(median_price), 6) AS median, round(quantile_cont(median_price, 0.75), 6) AS q3 FROM w GROUP BY 1, 2",
    "complete_window_summary": f"""WITH {_win(36)}, l AS (
  SELECT event_key, unit, risk_rating, m, 'median_price' AS metric_name, median_price AS v FROM w UNION ALL SELECT event_key, unit, risk_rating, m, 'orders_n', CAST(orders_n AS DOUBLE) FROM w),
h AS (SELECT l.*, h AS horizon_months FROM l, (SELECT unnest([12, 24, 36]) AS h) WHERE m BETWEEN -12 AND h),
c AS (SELECT event_key, metric_name, horizon_months FROM h GROUP BY 1, 2, 3 HAVING count(DISTINCT m) = 13 + horizon_months),
k AS (SELECT h.*, {_PHASE} AS event_window_phase FROM h JOIN c USING (event_key, metric_name, horizon_months)),
g AS (SELECT 'all_counties' AS aggregation_level, CAST(NULL AS VARCHAR) AS risk_rating, horizon_months, m, event_window_phase, metric_name, v, event_key, unit FROM k UNION ALL SELECT 'nri_risk_rating', risk_rating, horizon_months, m, event_window_phase, metric_name, v, event_key, unit FROM k)
SELECT aggregation_level, risk_rating, horizon_months, m AS event_window_month, event_window_phase, metric_name, round(avg(v), 6) AS mean, count(DISTINCT event_key) AS county_event_count, count(DISTINCT unit) AS county_count,
  round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM g GROUP BY 1, 2, 3, 4, 5, 6""",
    "complete_line_filter": f"WITH {_win(36)} SELECT event_key FROM w WHERE median_price IS NOT NULL GROUP BY 1 HAVING count(DISTINCT m) = 49",
    "event_phase_counts": f"WITH {_win(24)} SELECT {_PHASE} AS event_window_phase, count(*) AS n_rows, count(DISTINCT event_key) AS n_events, min(mfs) AS first_month, max(mae) AS last_month FROM w GROUP BY 1",
    "state_month_baseline": f"""WITH {_win(12)}, o AS (SELECT 'orders|' || CAST(event_key AS VARCHAR) || '|' || CAST(sm AS VARCHAR) || '|' || CAST(em AS VARCHAR) AS event_group, * FROM w),
a AS (SELECT DISTINCT event_group, unit FROM o), full_a AS (SELECT event_group, unit FROM o GROUP BY 1, 2 HAVING count(DISTINCT m) = 25),
t AS (SELECT o.* FROM o JOIN full_a USING (event_group, unit)),
c AS (SELECT t.event_group, t.unit, t.m, median(p.median_price) AS control FROM t JOIN panel p ON p.region = t.region AND p.period = t.period AND p.unit <> t.unit
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.event_group = t.event_group AND a.unit = p.unit) GROUP BY 1, 2, 3),
full_c AS (SELECT event_group, unit FROM c GROUP BY 1, 2 HAVING count(DISTINCT m) = 25),
u AS (SELECT event_group, m, 'affected' AS status, median(median_price) AS v, count(DISTINCT unit) AS county_count FROM t GROUP BY 1, 2 UNION ALL SELECT event_group, m, 'baseline', median(control), count(DISTINCT unit) FROM c JOIN full_c USING (event_group, unit) GROUP BY 1, 2)
SELECT event_group, m AS event_window_month, 'median_price' AS metric_name, status, round(v, 6) AS median, county_count, {_PHASE} AS event_window_phase FROM u""",
    "latest_complete_year_window": f"WITH {_PANEL}, y AS (SELECT year(period) AS y FROM panel GROUP BY 1 HAVING count(DISTINCT month(period)) = 12) SELECT make_date(max(y) - 9, 1, 1) AS window_start, make_date(max(y) + 1, 1, 1) AS window_end FROM y HAVING max(y) IS NOT NULL",
    "median_of_medians": f"WITH {_win(12)}, i AS (SELECT unit, event_key, median(median_price) AS x FROM w GROUP BY 1, 2) SELECT unit, round(median(x), 6) AS target FROM i GROUP BY 1",
    "mean_by_key": f"WITH {_win(12)} SELECT unit, round(avg(median_price), 6) AS target, count(*) AS n FROM w GROUP BY 1",
    "dense_month_array": f"""WITH {_PANEL}, axis AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM panel), (SELECT max(period) FROM panel), INTERVAL 1 MONTH)) AS DATE) AS period)
SELECT u.unit, string_agg(coalesce(CAST(p.orders_n AS VARCHAR), '-'), ',' ORDER BY a.period) AS series FROM (SELECT DISTINCT unit FROM panel) u CROSS JOIN axis a LEFT JOIN panel p ON p.unit = u.unit AND p.period = a.period GROUP BY 1""",
    "risk_group_series": f"WITH {_RATED} SELECT risk_rating, period, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3 FROM med",
    "historical_assignment": f"""WITH {_RATED}, l AS (SELECT risk_rating, median(q2) AS b, median(q3) AS c, median(q1) AS d FROM med GROUP BY 1), o AS (SELECT unit, risk_rating, median(median_price) AS a FROM rated GROUP BY 1, 2), j AS (SELECT * FROM o JOIN l USING (risk_rating))
SELECT unit, risk_rating, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, CASE WHEN a >= b THEN CASE WHEN a = b OR a - b < (c - b) / 2 THEN 'Mild Overperformer' ELSE 'Strong Overperformer' END WHEN b - a < (b - d) / 2 THEN 'Mild Underperformer' ELSE 'Strong Underperformer' END AS assignment FROM j""",
    "relative_position": f"""WITH {_RATED}, j AS (SELECT unit, round(median_price, 6) AS x, round(q1, 6) AS lo, round(q3, 6) AS hi FROM rated JOIN med USING (risk_rating, period))
SELECT unit, count(*) FILTER (x > hi) AS upper, count(*) FILTER (x <= hi AND x >= lo) AS mid, count(*) FILTER (x <= hi AND x < lo) AS lower FROM j GROUP BY 1""",
    "global_zscore_index": f"""WITH {_PANEL}, s AS (SELECT avg(median_price) AS a1, stddev_samp(median_price) AS s1, avg(orders_n) AS a2, stddev_samp(orders_n) AS s2, avg(mean_price) AS a3, stddev_samp(mean_price) AS s3 FROM panel),
z AS (SELECT unit, period, (median_price - a1) / s1 AS z1, -(orders_n - a2) / s2 AS z2, (mean_price - a3) / s3 AS z3 FROM panel, s)
SELECT unit, period, round(z1, 6) AS z_median_price, round(z2, 6) AS z_orders_n, round(z3, 6) AS z_mean_price, round((z1 + z2 + z3) / 3, 6) AS composite FROM z""",
    "event_expectation": f"""WITH {_win(36)}, d AS (SELECT risk_rating, median(median_price) FILTER (m BETWEEN 25 AND 36) - median(median_price) FILTER (m BETWEEN -12 AND -1) AS change FROM w GROUP BY 1)
SELECT risk_rating, round(change, 6) AS change, CASE WHEN change IS NULL THEN NULL WHEN abs(change) <= 100 THEN 'flat' WHEN change > 0 THEN 'up' ELSE 'down' END AS direction FROM d""",
    "band_fit": f"""WITH {_win(12)}, full_lines AS (SELECT event_key FROM w GROUP BY 1 HAVING count(DISTINCT m) = 25), k AS (SELECT w.* FROM w JOIN full_lines USING (event_key)),
b AS (SELECT risk_rating, m, round(quantile_cont(median_price, 0.25), 6) AS q1, round(median(median_price), 6) AS q2, round(quantile_cont(median_price, 0.75), 6) AS q3 FROM k GROUP BY 1, 2),
x AS (SELECT risk_rating, max(q3 - q1) AS wd FROM b GROUP BY 1),
j AS (SELECT event_key, risk_rating, m, median_price AS v, q1 - 0.5 * wd AS lo, q3 + 0.5 * wd AS hi, greatest(abs(wd), 0.01) AS sc, (median_price - q2) / greatest(abs(q3 - q1), 0.01) AS gap, q2 FROM k JOIN b USING (risk_rating, m) JOIN x USING (risk_rating))
SELECT event_key, risk_rating, count(DISTINCT m) AS months, bool_and(v >= lo AND v <= hi) AS eligible, round(max(greatest(lo - v, v - hi, 0) / sc), 6) AS max_deviation, round(avg(greatest(lo - v, v - hi, 0) / sc), 6) AS mean_deviation,
  round(median(gap), 6) AS median_standardised_gap, round(avg(CASE WHEN v > q2 THEN 1.0 ELSE 0.0 END), 6) AS above_median_share, round(avg(v), 6) AS avg_metric FROM j GROUP BY 1, 2""",
    "ten_year_avg": f"WITH {_LOCATED} SELECT unit, round(avg(o_totalprice), 6) AS avg_price, count(DISTINCT year(day)) AS years FROM located WHERE year(day) >= (SELECT max(year(day)) FROM located) - 3 GROUP BY 1",
    "eligible_event_range": f"WITH {_EVENTS} SELECT event_key, unit, sm AS event_start_month, em AS event_end_month FROM ev WHERE sm >= (SELECT min(period) + INTERVAL 12 MONTH FROM panel) AND em <= (SELECT max(period) - INTERVAL 12 MONTH FROM panel) AND unit IN (SELECT unit FROM panel)",
}
