"""Queries of the composite analyses over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators import analysis
from loomstead.plans.panel import RATINGS, Events, _EVENTS, _PANEL, _RATING, _win, _windows, great_orders, over_all_orders, panel, r6, rating
from loomstead.plans.tables import table

YEARS = 4


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit"), rating("n_nationkey").alias("risk_rating"))


def price_risk_latest(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.price_risk(panel(spark, sf), _risk(spark, sf), "unit", "risk_rating", "period", "mean_price", YEARS)
    caps = out["caps"]
    return out["latest"].crossJoin(F.broadcast(caps)).select("unit", "risk_rating", *[F.round(c, 4).alias(c) for c in ("latest_mean", "low", "high")])


def price_risk_bands(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.price_risk(panel(spark, sf), _risk(spark, sf), "unit", "risk_rating", "period", "orders_n", YEARS)
    return out["bands"]


def window_view_lines(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    out = analysis.window_view(_windows(spark, sf, 12, events), "event_key", "unit", "risk_rating", "median_price", 12, 12)
    return out["lines"].select("event_key", "unit", "risk_rating", r6("avg_value").alias("avg_value"), "min_value", "max_value", "pct_rank")


def feature_members(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    """Subgroups of the units of each rating by their median target after events."""
    feats = panel(spark, sf).groupBy("unit").agg(F.avg("orders_n").alias("volume"), F.avg("median_price").alias("price")).join(_risk(spark, sf), "unit")
    out = analysis.feature_analysis(feats, ["volume", "price"], _windows(spark, sf, 12, events).drop("region"), "event_key", "unit", "risk_rating", "median_price", RATINGS, 12, 12)
    return out["members"].select("unit", "risk_rating", r6("target").alias("target"), "subgroup")


def feature_correlations(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    feats = panel(spark, sf).groupBy("unit").agg(F.avg("orders_n").alias("volume"), F.avg("median_price").alias("price")).join(_risk(spark, sf), "unit")
    out = analysis.feature_analysis(feats, ["volume", "price"], _windows(spark, sf, 12, events).drop("region"), "event_key", "unit", "risk_rating", "median_price", RATINGS, 12, 12)
    return out["correlations"]


def unit_histories(spark: SparkSession, sf: str, events: Events = great_orders) -> DataFrame:
    out = analysis.county_histories(panel(spark, sf), events(spark, sf), "unit", "period", "orders_n", YEARS)
    keys = F.array_join(F.transform("events", lambda e: e["event_key"].cast("string")), ",")
    return out.select("unit", F.size("history").alias("months"), F.size(F.filter("history", lambda x: x.isNotNull())).alias("observed"), "sufficient", keys.alias("event_keys"))


QUERIES = {f.__name__: f for f in (price_risk_latest, price_risk_bands, window_view_lines, feature_members, feature_correlations, unit_histories)}
QUERIES |= over_all_orders(window_view_lines, feature_members, feature_correlations, unit_histories)

_SPAN = f"{_PANEL}, y AS (SELECT max(y) AS y FROM (SELECT year(period) AS y FROM panel GROUP BY 1 HAVING count(DISTINCT month(period)) = 12)), rec AS (SELECT p.*, {_RATING.format('unit')} AS risk_rating FROM panel p, y WHERE year(period) BETWEEN y - {YEARS - 1} AND y)"
_FULL = "full_lines AS (SELECT event_key FROM w GROUP BY 1 HAVING count(DISTINCT m) = 25), k AS (SELECT w.* FROM w JOIN full_lines USING (event_key))"
SQL = {
    "price_risk_latest": f"WITH {_SPAN}, l AS (SELECT unit, risk_rating, avg(mean_price) AS v FROM rec, y WHERE year(period) = y GROUP BY 1, 2), c AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM l) SELECT unit, risk_rating, round(v, 4) AS latest_mean, round(lo, 4) AS low, round(hi, 4) AS high FROM l, c",
    "price_risk_bands": f"WITH {_SPAN}, f AS (SELECT unit FROM rec GROUP BY 1 HAVING count(DISTINCT period) = {12 * YEARS}) SELECT risk_rating, period, round(quantile_cont(orders_n, 0.25), 5) AS q1, round(median(orders_n), 5) AS median, round(quantile_cont(orders_n, 0.75), 5) AS q3 FROM rec JOIN f USING (unit) GROUP BY 1, 2",
    "window_view_lines": f"""WITH {_win(12)}, {_FULL}, a AS (SELECT event_key, unit, risk_rating, avg(median_price) AS v, min(median_price) AS mn, max(median_price) AS mx FROM k GROUP BY 1, 2, 3)
SELECT event_key, unit, risk_rating, round(v, 6) AS avg_value, mn AS min_value, mx AS max_value, round((rank() OVER (PARTITION BY risk_rating ORDER BY v) + (count(*) OVER (PARTITION BY risk_rating, v) - 1) / 2.0) / count(*) OVER (PARTITION BY risk_rating) * 100, 1) AS pct_rank FROM a""",
    "feature_members": f"""WITH {_win(12)}, {_FULL}, t AS (SELECT unit, median(x) AS target FROM (SELECT unit, event_key, median(median_price) AS x FROM k GROUP BY 1, 2) GROUP BY 1), r AS (SELECT unit, {_RATING.format('unit')} AS risk_rating, target FROM t)
SELECT unit, risk_rating, round(target, 6) AS target, CAST(least(floor((row_number() OVER (PARTITION BY risk_rating ORDER BY target DESC, unit) - 1) * 4 / count(*) OVER (PARTITION BY risk_rating)), 3) AS INT) AS subgroup FROM r""",
    "unit_histories": f"""WITH {_SPAN.replace(_PANEL, _EVENTS)}, h AS (SELECT unit, count(*) AS observed FROM rec WHERE orders_n IS NOT NULL GROUP BY 1), m AS (SELECT count(DISTINCT period) AS months FROM rec),
e AS (SELECT unit, string_agg(CAST(event_key AS VARCHAR), ',' ORDER BY sm, em, event_key) AS keys FROM ev GROUP BY 1) SELECT h.unit, CAST(months AS INT) AS months, CAST(observed AS INT) AS observed, observed * 2 >= months AS sufficient, coalesce(keys, '') AS event_keys FROM h, m LEFT JOIN e ON e.unit = h.unit""",
}
