"""The analyses built from windows, ranks and quantiles: price and risk, window views, feature comparison, county histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.events import disaster_events, latest_complete_year
from loomstead.operators.relational import assert_unique_key, complete_members, complete_only, dense_series, equal_groups, first_per_key, percent_rank_average, top_with_minimum
from loomstead.operators.stats import bootstrap_interval, quartiles, spearman
from loomstead.operators.windows import HORIZONS, PRE, band_fit, event_windows, unpivot, window_summary

LEAST_EFFECT = 0.10
FACTOR_THRESHOLD = 0.30
LEAST_FACTORS = 3
SEED = 20260814
#: The provider's five ratings, as the summary has them.
PROVIDER_RATINGS = ("Very Low", "Relatively Low", "Relatively Moderate", "Relatively High", "Very High")


def within_latest_years(panel: DataFrame, period: str, years: int = 10) -> DataFrame:
    """Rows of the years that end with the latest complete one; ValueError if no year is complete."""
    window = latest_complete_year(panel, period, years).first()  # one row
    if window is None:
        raise ValueError("no year has all twelve months")
    return panel.filter((F.col(period) >= F.lit(window["window_start"])) & (F.col(period) < F.lit(window["window_end"])))


def price_risk(panel: DataFrame, risk: DataFrame, unit: str, rating: str, period: str, value: str, years: int = 10) -> dict[str, DataFrame]:
    """latest: mean of the latest complete year per rated unit; caps: its 1st and 99th percentile; bands: monthly quartiles by
    rating of the units that have every month; history: one dense series per unit with any value."""
    recent = within_latest_years(panel, period, years).select(unit, period, value)
    last = recent.agg(F.year(F.max(period)).alias("__y"))
    latest = recent.join(F.broadcast(last), F.year(period) == F.col("__y")).groupBy(unit).agg(F.avg(value).alias("latest_mean")).filter("latest_mean is not null").join(risk.select(unit, rating), unit)
    caps = latest.agg(F.percentile("latest_mean", F.lit(0.01)).alias("low"), F.percentile("latest_mean", F.lit(0.99)).alias("high"))
    whole = complete_members(recent, [unit], period, size=12 * years, value=value)
    bands = quartiles(recent.join(whole, unit, "left_semi").join(risk.select(unit, rating), unit).filter(F.col(rating).isNotNull()), [rating, period], value, 5)
    live = recent.join(recent.filter(F.col(value).isNotNull()).select(unit).distinct(), unit, "left_semi")
    return {"latest": latest, "caps": caps, "bands": bands, "history": dense_series(live, [unit], recent.select(period), period, value)}


def window_view(windows: DataFrame, line: str, unit: str, rating: str, value: str, pre: int = PRE, post: int = 36) -> dict[str, DataFrame]:
    """One view of complete lines: bands to five decimals, lines (mean, extremes, percentile rank, fit to the band) and the best line of each unit."""
    rows = windows.filter(F.col("event_window_month").between(-pre, post) & F.col(value).isNotNull())
    rows = complete_only(rows, [line], "event_window_month", pre + 1 + post)
    rated = rows.filter(F.col(rating).isNotNull())
    bands = quartiles(rated, [rating, "event_window_month"], value, 5)
    facts = rows.groupBy(line, unit, rating).agg(F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.max(F.abs(value)).alias("max_abs_value"))
    facts = facts.withColumn("pct_rank", percent_rank_average("avg_value", [rating]))
    fit = band_fit(rated, bands, line, [rating, "event_window_month"], value).drop("avg_metric", rating)
    lines = facts.join(fit, line, "left")
    best = first_per_key(lines, [unit], [F.col("avg_value").desc_nulls_last(), F.col(line)]).select(unit, F.col("pct_rank").alias("county_pct"))
    counts = rows.agg(F.countDistinct(line).alias("lines"), F.countDistinct(unit).alias("units"))
    return {"bands": bands, "lines": lines, "units": best, "summary": counts}


def feature_analysis(features: DataFrame, names: Sequence[str], windows: DataFrame, line: str, unit: str, rating: str, value: str, ratings: Sequence[str], pre: int = PRE, post: int = 36) -> dict[str, DataFrame]:
    """Which features go with how units fare after events, within each rating.

    Targets: the mean over all observations, and the median over months, then lines, of complete lines.
    Correlations: rank correlation of each feature with the median target, its resampled interval, and
    whether the interval lies beyond LEAST_EFFECT on one side. Traits: features by the size of the
    correlation, all from FACTOR_THRESHOLD on and at least LEAST_FACTORS. Subgroups: four equal parts of
    a rating by the target; their members, quartiles of the traits, and monthly medians of the units'
    medians.
    """
    span = windows.filter(F.col("event_window_month").between(-pre, post) & F.col(value).isNotNull())
    mean_target = span.groupBy(unit).agg(F.avg(value).alias("mean_target"))
    whole = complete_only(span, [line], "event_window_month", pre + 1 + post)
    target = whole.groupBy(unit, line).agg(F.median(value).alias("__m")).groupBy(unit).agg(F.median("__m").alias("target"))
    units = features.filter(F.col(rating).isin(*ratings)).join(target, unit, "left").join(mean_target, unit, "left")
    long = unpivot(units, [unit, rating, "target"], names, "feature", "x").filter("target is not null")
    rho = spearman(long, [rating, "feature"], "x", "target")
    at = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1
    ci = bootstrap_interval(long.withColumn("__seed", F.lit(SEED) + 100 * at(ratings, rating) + at(names, "feature")), [rating, "feature"], "x", "target", "__seed").drop("pairs")
    corr = rho.join(ci, [rating, "feature"], "left").withColumn("passes_threshold", F.coalesce((F.col("ci_low") >= LEAST_EFFECT) | (F.col("ci_high") <= -LEAST_EFFECT), F.lit(False)))
    order = corr.withColumn("__i", at(names, "feature"))
    traits = top_with_minimum(order, [rating], "rho", FACTOR_THRESHOLD, LEAST_FACTORS, ["__i"]).select(rating, "feature", "rho", F.col("rn").alias("place"))
    members = units.filter("target is not null").withColumn("subgroup", equal_groups([rating], [F.col("target").desc(), F.col(unit)])).select(unit, rating, "target", "subgroup")
    sizes = members.groupBy(rating, "subgroup").agg(F.count(F.lit(1)).alias("units"), F.median("target").alias("target_median"), F.min("target").alias("target_min"), F.max("target").alias("target_max"))
    trait_values = long.join(traits.select(rating, "feature"), [rating, "feature"]).join(members.select(unit, "subgroup"), unit)
    trait_bands = quartiles(trait_values, [rating, "subgroup", "feature"], "x")
    monthly = whole.drop(rating).join(members.select(unit, rating, "subgroup"), unit).groupBy(rating, "subgroup", unit, "event_window_month").agg(F.median(value).alias("__m")).groupBy(rating, "subgroup", "event_window_month").agg(F.median("__m").alias("median"))
    return {"targets": units.select(unit, rating, "target", "mean_target"), "correlations": corr, "traits": traits, "members": members, "subgroups": sizes, "trait_bands": trait_bands, "monthly": monthly}


def county_histories(panel: DataFrame, events: DataFrame, unit: str, period: str, value: str, years: int = 10) -> DataFrame:
    """Per unit a dense series of the latest complete years and its events as one sorted array; units without events have an empty one."""
    recent = within_latest_years(panel, period, years)
    series = dense_series(recent, [unit], recent.select(period), period, value, "history")
    per = events.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("event_start_month", "event_end_month", "event_key"))).alias("events"))
    out = series.join(per, unit, "left")
    empty = F.array().cast(per.schema["events"].dataType)
    return out.withColumn("events", F.coalesce("events", empty)).withColumn("sufficient", F.size(F.filter("history", lambda x: x.isNotNull())) * 2 >= F.size("history"))


def analysis_marts(events: DataFrame, panel: DataFrame, risk: DataFrame, unit: str, rating: str, period: str, metrics: Sequence[str], horizons: Sequence[int] = HORIZONS, ratings: Sequence[str] = PROVIDER_RATINGS) -> dict[str, DataFrame]:
    """config, events, windows and summary; the keys of events, windows and summary are checked."""
    spark = panel.sparkSession
    post = max(horizons)
    config = spark.createDataFrame([("pre_months", str(PRE)), ("post_months", str(post)), ("horizons", ",".join(map(str, horizons)))], "parameter string, value string")
    bounds = panel.agg(F.add_months(F.min(period), PRE).alias("__lo"), F.add_months(F.max(period), -PRE).alias("__hi"))
    kept = disaster_events(events).join(F.broadcast(bounds), F.col("event_start_month").between(F.col("__lo"), F.col("__hi")) & (F.col("event_end_month") <= F.col("__hi"))).drop("__lo", "__hi")
    kept = first_per_key(kept.join(panel.select(unit), unit, "left_semi"), ["event_key"], [F.col("event_start_month"), F.col("event_end_month"), F.col(unit)])
    assert_unique_key(kept, ["event_key"])
    rows = event_windows(kept.withColumn("line_id", F.col("event_key")), panel, unit, period, PRE, post).join(risk.select(unit, rating), unit, "left")
    assert_unique_key(rows, ["line_id", period])
    summary = window_summary(rows, "line_id", unit, rating, metrics, horizons, PRE, ratings)
    assert_unique_key(summary, ["aggregation_level", "risk_rating", "horizon_months", "event_window_month", "metric_name"])
    return {"event_window_config": config, "extreme_events_county": kept, "housing_event_windows_monthly": rows, "housing_event_window_summary": summary}


def story_lines(lines: DataFrame, focus: Sequence[str], line: str) -> DataFrame:
    """The lines in focus; ValueError if one is missing."""
    found = lines.filter(F.col(line).isin(*focus))
    have = {r[0] for r in found.select(line).distinct().collect()}  # as many as are in focus
    if missing := sorted(set(focus) - have):
        raise ValueError(f"lines not found: {missing}")
    return found.withColumn("focus_rank", F.row_number().over(Window.partitionBy(line).orderBy(line)))
