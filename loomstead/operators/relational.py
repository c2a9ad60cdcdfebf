"""Relational building blocks that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or ValueError if any key combination occurs twice; null keys count as equal."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"key {list(keys)} is not unique: {bad[0].asDict()}")
    return df


def spine_join(sources: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Every key of any source once, with each source's columns and a flag has_<source>; rows with a null key are left out."""
    spine = reduce(DataFrame.union, [d.select(*keys) for d in sources.values()]).distinct()
    spine = reduce(lambda d, k: d.filter(F.col(k).isNotNull()), keys, spine)
    for name, d in sources.items():
        spine = spine.join(d.withColumn(f"has_{name}", F.lit(True)), list(keys), "left")
    return spine.withColumns({f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in sources})


def complete_members(df: DataFrame, member: Sequence[str], axis: str, required: Column | None = None, size: int | None = None, value: str | None = None) -> DataFrame:
    """Relational division: the members that have every required axis value with a value that is not null.

    required selects the axis values and size is their number; without them all axis values met are
    required. size 0 gives nothing. Two hash aggregates; no member is compared with another.
    """
    rows = df if required is None else df.filter(required)
    rows = rows if value is None else rows.filter(F.col(value).isNotNull())
    rows = reduce(lambda d, k: d.filter(F.col(k).isNotNull()), member, rows)
    have = rows.groupBy(*member).agg(F.countDistinct(axis).alias("__have"))
    if size is not None:
        return have.filter((F.col("__have") == size) & (F.lit(size) > 0)).drop("__have")
    need = df.agg(F.countDistinct(axis).alias("__need"))
    return have.join(F.broadcast(need), F.col("__have") == F.col("__need")).drop("__have", "__need")


def complete_only(df: DataFrame, member: Sequence[str], axis: str, size: Column | int) -> DataFrame:
    """Rows of the members that have size different axis values: division and the way back to the rows in one ordering.

    For members of a bounded number of rows, such as the months of one line; complete_members serves others.
    """
    w = Window.partitionBy(*member)
    need = F.lit(size) if isinstance(size, int) else size
    return df.withColumn("__set", F.collect_set(axis).over(w)).filter((F.size("__set") == need) & (need > 0)).drop("__set")


def islands(df: DataFrame, entity: Sequence[str], start: str, end: str, tolerance_days: int, order: Sequence[str] = (), name: str = "island") -> DataFrame:
    """Number the clusters of intervals per entity: a row opens a new one if it starts more than tolerance_days after the running maximum end.

    Equality at the tolerance joins. A null start opens a cluster of its own; null entities stand together.
    """
    w = Window.partitionBy(*entity).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last(), *order)
    reach = F.max(F.coalesce(end, start)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col(start).isNull() | reach.isNull() | (F.col(start).cast("timestamp_ntz") > reach.cast("timestamp_ntz") + F.make_dt_interval(F.lit(tolerance_days)))
    return df.withColumn("__fresh", F.when(fresh, 1).otherwise(0)).withColumn(name, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count_as: str | None = None) -> DataFrame:
    """The first row of each key in an order, optionally with the number of rows of the key."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("__r", F.row_number().over(w.orderBy(*order)))
    if count_as:
        out = out.withColumn(count_as, F.count(F.lit(1)).over(w))
    return out.filter("__r = 1").drop("__r")


def best_match(left: DataFrame, right: DataFrame, on: Column, left_key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """For each left row the best right row under a condition with an equality in it; unmatched left rows are left out."""
    return first_per_key(left.join(right, on), left_key, order)


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Rank of a value in its group, ties sharing the mean of their ranks; null for null."""
    by_value = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*group, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def percent_rank_average(value: str, group: Sequence[str]) -> Column:
    """Average rank over the number of values, in percent, to one decimal."""
    n = F.count(value).over(Window.partitionBy(*group))
    return F.round(average_rank(value, group) / F.nullif(n, F.lit(0)) * 100, 1)


def equal_groups(group: Sequence[str], order: Sequence[Column], parts: int = 4) -> Column:
    """Parts of nearly equal size, min(floor(i * parts / n), parts - 1) for the i-th row; sizes differ by one at most, the surplus is spread."""
    w = Window.partitionBy(*group)
    return F.least(F.floor((F.row_number().over(w.orderBy(*order)) - 1) * parts / F.count(F.lit(1)).over(w)), F.lit(parts - 1)).cast("int")


def top_with_minimum(df: DataFrame, group: Sequence[str], score: str, threshold: float, at_least: int, tie: Sequence[str]) -> DataFrame:
    """Rows by falling |score|: all that reach the threshold, and at any rate the first at_least; null and NaN scores do not count."""
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    w = Window.partitionBy(*group)
    ranked = ok.withColumn("rn", F.row_number().over(w.orderBy(F.abs(score).desc(), *tie)))
    ranked = ranked.withColumn("__n", F.count_if(F.abs(score) >= threshold).over(w))
    return ranked.filter(F.col("rn") <= F.greatest(F.lit(at_least), F.col("__n"))).drop("__n")


def joined_unique(c: Column | str, numeric: bool = False) -> Column:
    """Aggregate: the distinct trimmed, not empty values joined by a bar; numeric ids first in the order of numbers, then text."""
    col = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    kept = F.collect_set(F.when(F.length(col) > 0, col))
    if not numeric:
        return F.array_join(F.array_sort(kept), "|")
    keyed = F.transform(kept, lambda x: F.struct((~x.rlike(r"^\d+$")).alias("text"), F.when(x.rlike(r"^\d+$"), x.try_cast("decimal(38,0)")).alias("n"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), "|")


def dense_series(df: DataFrame, key: Sequence[str], axis: DataFrame, axis_col: str, value: str, name: str = "series") -> DataFrame:
    """One array per key with a value for every point of a small axis, null where the key has none."""
    keys = df.select(*key).distinct()
    grid = keys.crossJoin(F.broadcast(axis.select(axis_col).distinct()))
    filled = grid.join(df.select(*key, axis_col, value), [*key, axis_col], "left")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(axis_col), F.col(value))))
    return filled.groupBy(*key).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def latest_years(df: DataFrame, year: str, years: int = 10) -> DataFrame:
    """Rows of the last years of the table, by one aggregate that is broadcast (one row)."""
    top = df.agg(F.max(year).alias("__top"))
    return df.join(F.broadcast(top), F.col(year) >= F.col("__top") - (years - 1)).drop("__top")
