"""Assignments and scorecards of counties against their rating group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.stats import quartiles


def group_series(panel: DataFrame, rating: str, month: str, value: str) -> DataFrame:
    """q1, median, q3 per rating and month over the units with a value."""
    return quartiles(panel.filter(F.col(value).isNotNull()), [rating, month], value)


def history_statistics(panel: DataFrame, unit: str, rating: str, month: str, value: str) -> DataFrame:
    """a: the unit's median; b, c, d: medians over months of its rating's median, upper and lower quartile; null without rating."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    monthly = panel.filter(F.col(value).isNotNull()).groupBy(rating, month).agg(q.alias("q"))
    level = monthly.groupBy(rating).agg(F.median(F.col("q")[1]).alias("b"), F.median(F.col("q")[2]).alias("c"), F.median(F.col("q")[0]).alias("d"))
    own = panel.groupBy(unit, rating).agg(F.median(value).alias("a"))
    return own.join(F.broadcast(level), rating, "left").select(unit, rating, "a", "b", "c", "d")


def historical_assignment(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Over or under the group's median, strong beyond half of the way to its quartile; a tie is Mild Over."""
    return (
        F.when(a.isNull() | b.isNull() | c.isNull() | d.isNull(), None)
        .when((a >= b) & ((a == b) | (a - b < (c - b) / 2)), "Mild Overperformer").when(a >= b, "Strong Overperformer")
        .when(b - a < (b - d) / 2, "Mild Underperformer").otherwise("Strong Underperformer")
    )


def relative_position(x: Column, q1: Column, q3: Column) -> Column:
    return F.when(x > q3, "Upper range").when(x < q1, "Lower range").when(x.isNotNull() & q1.isNotNull() & q3.isNotNull(), "Mid range")


def factor_position(x: Column, peer_median: Column) -> Column:
    return F.when(x.isNull() | peer_median.isNull(), "Data unavailable").when(x > peer_median, "Higher").when(x < peer_median, "Lower").otherwise("At peer median")


def factor_growth(position: Column, rho: Column) -> Column:
    """+1 where the position points the way of the correlation, -1 against it, 0 at the median, null where either is missing."""
    side = F.when(position == "Higher", 1).when(position == "Lower", -1).when(position == "At peer median", 0)
    return F.when(rho.isNotNull(), side * F.sign(rho).cast("int"))


def scorecard(rating: Column, performer: Column, balance: Column) -> Column:
    """Low risk, outperformance and a positive balance of factors, one point each: 3 Low, 2 Moderate, else High."""
    points = F.when(rating.isin("Very Low", "Low"), 1).otherwise(0) + F.when(performer.contains("Over"), 1).otherwise(0) + F.when(balance > 0, 1).otherwise(0)
    return F.when(rating.isNull() | performer.isNull() | balance.isNull(), "Insufficient data").when(points == 3, "Low").when(points == 2, "Moderate").otherwise("High")


def sufficient_history(df: DataFrame, unit: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """Units of whose rows at least share have a value."""
    ok = F.avg(F.col(value).isNotNull().cast("double"))
    return df.groupBy(*unit).agg(ok.alias("share")).filter(F.col("share") >= share)


def subgroup_from_ranges(value: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(contained first, distance to the range to twelve decimals): order subgroups by these and take the first."""
    inside = value.between(low, high)
    return F.when(inside, 0).otherwise(1), F.round(F.greatest(low - value, value - high, F.lit(0.0)), 12)


def share_above(df: DataFrame, peers: Sequence[str], subgroup: str, value: str) -> DataFrame:
    """Per subgroup the percentage of values strictly above, and strictly below, the median of all peers."""
    med = df.groupBy(*peers).agg(F.median(value).alias("__m"))
    j = df.join(med, list(peers)).filter(F.col(value).isNotNull())
    return j.groupBy(*peers, subgroup).agg(
        (F.count_if(F.col(value) > F.col("__m")) * 100.0 / F.count(F.lit(1))).alias("above_pct"), (F.count_if(F.col(value) < F.col("__m")) * 100.0 / F.count(F.lit(1))).alias("below_pct")
    )


def event_expectation(windows: DataFrame, group: str, value: str, flat: float = 0.005) -> DataFrame:
    """Median over months 25..36 less the median over the year before the event, with its direction."""
    part = lambda lo, hi: F.median(F.when(F.col("event_window_month").between(lo, hi), F.col(value)))
    d = windows.groupBy(group).agg((part(25, 36) - part(-12, -1)).alias("change"))
    return d.withColumn("direction", F.when(F.col("change").isNull(), None).when(F.abs("change") <= flat, "flat").when(F.col("change") > 0, "up").otherwise("down"))
