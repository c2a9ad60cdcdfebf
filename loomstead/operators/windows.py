"""Event windows over monthly panels: split-anchored months, complete lines, summaries and control baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.relational import complete_only
from loomstead.session import cut_lineage

PRE = 12
HORIZONS = (12, 24, 36, 48, 60)


def months_between(later: str, earlier: str) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def phase(month: Column | str, post: int, pre: int = PRE) -> Column:
    """'12 months before through event start', then blocks of twelve months after the end, the last cut at post."""
    m = F.col(month) if isinstance(month, str) else month
    out = F.when(m.between(-pre, 0), f"{pre} months before through event start")
    for first in range(1, post + 1, 12):
        last = min(first + 11, post)
        out = out.when(m.between(first, last), f"{first}-{last} months after event end")
    return out


def event_windows(events: DataFrame, panel: DataFrame, unit: str, period: str, pre: int = PRE, post: int = 24) -> DataFrame:
    """One row per event and panel month in its window.

    Months up to 0 count from the event's start month, later ones from its end month; what lies strictly
    between start and end is left out. Each event names the months it wants, so the panel is met by an
    equality join on unit and month, never by a range.
    """
    slots = events.withColumn("event_window_month", F.explode(F.sequence(F.lit(-pre), F.lit(post))))
    at = F.when(F.col("event_window_month") <= 0, F.add_months("event_start_month", F.col("event_window_month"))).otherwise(F.add_months("event_end_month", F.col("event_window_month")))
    slots = slots.withColumn(period, at)
    out = slots.join(panel, [unit, period])
    return out.withColumns({
        "event_duration_months": months_between("event_end_month", "event_start_month"),
        "months_from_event_start": months_between(period, "event_start_month"),
        "months_after_event_end": months_between(period, "event_end_month"),
        "event_window_phase": phase("event_window_month", post, pre),
    })


def alike_lines(events: DataFrame, line: str, weight: str) -> DataFrame:
    """The events of one line for all lines of equal events, with their number as weight; an event without a line is left out.

    Lines of equal events have equal windows, so that summaries need one of them, the least, and the weight.
    """
    rest = [c for c in events.columns if c != line]
    lines = events.filter(F.col(line).isNotNull()).groupBy(line).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("__alike"))
    return lines.groupBy("__alike").agg(F.min(line).alias(line), F.count(F.lit(1)).alias(weight)).select(line, weight, F.inline("__alike"))


def unpivot(df: DataFrame, keep: Sequence[str], metrics: Sequence[str], name: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """Long metrics without nulls."""
    return df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keep), list(metrics), name, value).filter(F.col(value).isNotNull())


def window_summary(windows: DataFrame, line: str, unit: str, rating: str, metrics: Sequence[str], horizons: Sequence[int] = HORIZONS, pre: int = PRE, ratings: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Median, mean, quartiles and counts per month of the lines complete up to each horizon, over all units and by rating.

    A line has one row a month, so lines are counted as rows. The months a line has of a metric are
    gathered once and judge every horizon; rows repeat for horizons only when they are counted. The level
    all includes units without a rating, so it is no rollup of the levels by rating. weight names the
    number of lines that a line stands for, as alike_lines gives it; without it each stands for itself.
    """
    windows = windows.withColumnRenamed(rating, "__rating").withColumn("__n", F.col(weight) if weight else F.lit(1).cast("long"))
    long = unpivot(windows, [line, unit, "__rating", "event_window_month", "__n"], metrics)
    long = long.filter((F.col("event_window_month") >= -pre) & (F.col("event_window_month") <= max(horizons)))
    # in the sorted months of a complete line, month h stands at place h + pre
    long = long.withColumn("__has", F.array_sort(F.collect_set("event_window_month").over(Window.partitionBy(line, "metric_name"))))
    fits = F.array(*[F.when((F.get("__has", F.lit(h + pre)) == h) & (F.col("event_window_month") <= h), F.lit(h)) for h in horizons])
    kept = long.withColumn("horizon_months", F.explode(F.array_compact(fits))).drop("__has")
    kept = kept.withColumn("event_window_phase", phase("event_window_month", max(horizons), pre))
    q = F.percentile("metric_value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("__n"))
    mean = F.sum(F.col("metric_value") * F.col("__n")) / F.sum("__n")
    aggs = [q.alias("__q"), mean.alias("mean"), F.coalesce(F.sum(F.when(F.col(line).isNotNull(), F.col("__n"))), F.lit(0)).alias("county_event_count"), F.countDistinct(unit).alias("county_count")]
    by = ["horizon_months", "event_window_month", "event_window_phase", "metric_name"]
    # each row counts at both levels: the level all_counties has no rating, whatever the row's is
    known = F.col("__rating").isin(*ratings) if ratings else F.col("__rating").isNotNull()
    level = lambda name, value: F.struct(F.lit(name).alias("aggregation_level"), value.cast("string").alias("risk_rating"))
    levels = F.array(level("all_counties", F.lit(None)), F.when(known, level("nri_risk_rating", F.col("__rating"))))
    kept = kept.withColumn("__l", F.explode(F.filter(levels, lambda x: x.isNotNull()))).select("*", "__l.*")
    out = kept.groupBy("aggregation_level", "risk_rating", *by).agg(*aggs)
    return out.withColumns({"q25": F.col("__q")[0], "median": F.col("__q")[1], "q75": F.col("__q")[2]}).drop("__q")


def baseline_windows(events: DataFrame, panel: DataFrame, unit: str, region: str, period: str, metrics: Sequence[str], pre: int = PRE, post: int = 24, digits: int | None = None) -> DataFrame:
    """Affected units against untouched units of the same region and month.

    Events of one source, id and months are a group. Per group, month and metric: the median over the
    affected units with complete windows, and the median over them of their control values, each the
    median of the same region's units that are neither the unit itself nor affected by the group.

    The control of an affected unit leaves out the unit itself, which is affected, so controls depend on
    the group, region and month only: each is made once, not once per affected unit, and no pair of
    units is formed beyond (group, region, month) times the region's units.

    Groups that affect the same units over the same months have the same rows but for their names. One of
    them, the least, stands for all in the joins with the panel, and its rows are handed to the others.
    Medians are rounded to digits, if given, before that.
    """
    key = F.concat_ws("|", "event_source", "source_event_id", F.col("event_start_month").cast("string"), F.col("event_end_month").cast("string"))
    events = events.select(unit, "event_start_month", "event_end_month", key.alias("event_group"))
    named = cut_lineage(events.groupBy("event_group").agg(F.array_sort(F.collect_set(F.struct(unit, "event_start_month", "event_end_month"))).alias("__alike")))
    heads = cut_lineage(named.groupBy("__alike").agg(F.min("event_group").alias("event_group")))
    rows = _baselines(heads.select("event_group", F.inline("__alike")), panel, unit, region, period, metrics, pre, post)
    rows = rows.withColumns({"median": F.col("median") if digits is None else F.round("median", digits), "event_window_phase": phase("event_window_month", post, pre)})
    packed = rows.groupBy("event_group").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "event_group"])).alias("__rows"))
    both = named.join(heads.join(packed, "event_group").select("__alike", "__rows"), "__alike").select("event_group", F.inline("__rows"))
    return both.withColumn("line_id", F.concat_ws(":", "event_group", "status", "metric_name"))


def _baselines(ev: DataFrame, panel: DataFrame, unit: str, region: str, period: str, metrics: Sequence[str], pre: int, post: int) -> DataFrame:
    """(event_group, event_window_month, metric_name, median, county_count, status) of the groups in ev."""
    affected = ev.select("event_group", unit).distinct()
    groups = ev.select("event_group", "event_start_month", "event_end_month").distinct()
    grid = groups.withColumn("event_window_month", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn(
        period, F.when(F.col("event_window_month") <= 0, F.add_months("event_start_month", F.col("event_window_month"))).otherwise(F.add_months("event_end_month", F.col("event_window_month")))
    ).drop("event_start_month", "event_end_month")
    long = cut_lineage(unpivot(panel, [unit, region, period], metrics))
    own = grid.join(affected, "event_group").join(long, [unit, period])
    size = pre + 1 + post
    own = complete_only(own, ["event_group", unit, "metric_name"], "event_window_month", size)
    month_key = ["event_group", "event_window_month", "metric_name"]
    treated = own.groupBy(*month_key).agg(F.median("metric_value").alias("median"), F.countDistinct(unit).alias("county_count")).withColumn("status", F.lit("affected"))
    wanted = own.select("event_group", region, period, "event_window_month", "metric_name").distinct()
    pool = wanted.join(long, [region, period, "metric_name"]).join(affected, ["event_group", unit], "left_anti")
    control = pool.groupBy("event_group", region, period, "event_window_month", "metric_name").agg(F.median("metric_value").alias("control"))
    lines = own.join(control, ["event_group", region, period, "event_window_month", "metric_name"])
    base = complete_only(lines, ["event_group", unit, "metric_name"], "event_window_month", size).groupBy(*month_key).agg(F.median("control").alias("median"), F.countDistinct(unit).alias("county_count")).withColumn("status", F.lit("baseline"))
    return treated.unionByName(base)


def band_fit(lines: DataFrame, bands: DataFrame, line: str, by: Sequence[str], value: str, slack: float = 0.5) -> DataFrame:
    """Per line: whether it stays within its band widened by slack band widths, and its largest and mean normalised deviation.

    bands has q1, median and q3 per (by); the width is the widest of the first key of by.
    """
    width = bands.groupBy(by[0]).agg(F.max(F.col("q3") - F.col("q1")).alias("__w"))
    j = lines.join(F.broadcast(bands.join(width, by[0])), list(by))
    lo, hi, x = F.col("q1") - slack * F.col("__w"), F.col("q3") + slack * F.col("__w"), F.col(value)
    scale = F.greatest(F.abs("__w"), F.lit(0.01))
    dev = F.greatest(lo - x, x - hi, F.lit(0.0)) / scale
    gap = (x - F.col("median")) / F.greatest(F.abs(F.col("q3") - F.col("q1")), F.lit(0.01))
    return j.groupBy(line, by[0]).agg(
        F.countDistinct(by[1]).alias("months"), F.bool_and((x >= lo) & (x <= hi)).alias("eligible"), F.max(dev).alias("max_deviation"), F.avg(dev).alias("mean_deviation"),
        F.median(gap).alias("median_standardised_gap"), F.avg((x > F.col("median")).cast("double")).alias("above_median_share"), F.avg(x).alias("avg_metric"),
    )
