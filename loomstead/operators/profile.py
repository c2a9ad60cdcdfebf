"""Column-level quality profiles per load, from mergeable counts and exact power sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.session import cut_lineage

#: Ranges of values per doubling, of which one is ordered to find a median.
RANGES = 1024
#: Largest scaled value of a power sum: its square fits a bigint, and so do the products of the halves of two squares.
LARGEST = 1_000_000_000
PLAIN_NUMBER = r"^\s*[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?\s*$"


@dataclass(frozen=True)
class ColumnRule:
    """One column of one table: values outside [low, high] or not matching pattern are bad."""

    table: str
    column: str
    low: float
    high: float
    pattern: str = PLAIN_NUMBER


def column_values(df: DataFrame, rule: ColumnRule, load: str) -> DataFrame:
    """(table_name, column_name, load_id, stored, number, n): each stored value of a load once, with its count.

    stored is null for a missing value (null, NaN, blank); number is null for a bad one. This is the one
    shuffle over the data; everything else works on these counts.
    """
    is_text = dict(df.dtypes)[rule.column] == "string"
    c = F.col(rule.column)
    if is_text:
        stored = F.when(F.trim(F.regexp_replace(c, r"\s+", " ")) != "", c)
        plain = F.when(stored.rlike(rule.pattern), F.regexp_replace(F.trim(stored), ",", "")).try_cast("double")
    else:
        plain = F.when(~F.isnan(c.cast("double")), c.cast("double"))
        stored = plain.cast("string")
    good = F.when((plain >= rule.low) & (plain <= rule.high), plain)
    return (
        df.select(F.col(load).alias("load_id"), stored.alias("stored"), good.alias("number"))
        .groupBy("load_id", "stored", "number")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(rule.table).alias("table_name"), F.lit(rule.column).alias("column_name"), "load_id", "stored", "number", "n")
    )


def _spread(c: Column) -> Column:
    """The value range a number falls in: RANGES per doubling."""
    mag = F.floor(F.log2(1 + F.abs(c)) * RANGES)
    return F.when(c < 0, -mag - 1).otherwise(mag)


def null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition by which a null key meets a null key."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def range_quantiles(values: DataFrame, keys: Sequence[str], number: str, n: str, at: dict[str, float]) -> DataFrame:
    """(keys, one column per name of at): exact quantiles of number weighted by n, interpolated between neighbouring ranks.

    Totals of value ranges find the ranges that hold the wanted ranks; only these are ordered, each in a
    task of its own, so no task sees a whole column. Null numbers do not count; a null key is a key of its
    own; keys without numbers give no row.
    """
    good = values.filter(F.col(number).isNotNull()).groupBy(*keys, F.col(number).alias("__x")).agg(F.sum(n).alias("__n"))
    ranges = good.groupBy(*keys, _spread(F.col("__x")).alias("__range")).agg(F.sum("__n").alias("__m"))
    place = lambda q: F.lit(q) * (F.col("__total") - 1)
    ends = [(c, side, (F.floor if side == "lo" else F.ceil)(place(q)).cast("long") + 1) for c, q in at.items() for side in ("lo", "hi")]
    ranked = (
        ranges.withColumn("__until", F.sum("__m").over(Window.partitionBy(*keys).orderBy("__range")))
        .withColumn("__total", F.sum("__m").over(Window.partitionBy(*keys)))
        .withColumn("__before", F.col("__until") - F.col("__m"))
        .withColumn("__ends", F.filter(F.array(*[F.struct(F.lit(f"{c} {side}").alias("c"), r.alias("r")) for c, side, r in ends]), lambda e: (e["r"] > F.col("__before")) & (e["r"] <= F.col("__until"))))
        .filter(F.size("__ends") > 0)
        .select(*keys, "__range", "__before", "__total", "__ends")
    )
    numbers = good.withColumn("__range", _spread(F.col("__x")))
    inside = numbers.alias("a").join(ranked.alias("b"), null_safe("a", "b", [*keys, "__range"])).select("a.*", "b.__before", "b.__total", "b.__ends")
    inside = inside.withColumn("__until", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy("__x")))
    hits = F.filter("__ends", lambda e: (e["r"] > F.col("__until") - F.col("__n")) & (e["r"] <= F.col("__until")))
    found = inside.select(*keys, "__x", "__total", F.explode(F.transform(hits, lambda e: e["c"])).alias("__c"))
    hit = lambda c, side: F.max(F.when(F.col("__c") == f"{c} {side}", F.col("__x")))
    sides = found.groupBy(*keys).agg(F.max("__total").alias("__total"), *[hit(c, side).alias(f"__{c}_{side}") for c in at for side in ("lo", "hi")])
    over = lambda q: place(q) - F.floor(place(q))
    return sides.select(*keys, *[((1 - over(q)) * F.col(f"__{c}_lo") + over(q) * F.col(f"__{c}_hi")).alias(c) for c, q in at.items()])


def digits_of(rule: ColumnRule) -> int:
    """Decimals kept in power sums: at most 6, so that a scaled value stays below LARGEST."""
    bound, digits = max(abs(rule.low), abs(rule.high), 1), 6
    while digits and bound * 10**digits > LARGEST:
        digits -= 1
    if bound > LARGEST:
        raise ValueError(f"power sums of {rule.column} take bounds of at most {LARGEST}")
    return digits


#: The parts of exact power sums of whole numbers y of at most LARGEST: y**2 is cut at 30 bits, so each product fits a bigint.
PARTS = {"s0": "1", "s1": "y", "s2": "q", "s3_high": "h * y", "s3_low": "l * y", "s4_high": "h * h", "s4_mid": "h * l", "s4_low": "l * l"}


def power_sums(values: DataFrame, keys: Sequence[str], scaled: str, n: str) -> DataFrame:
    """(keys, PARTS): exact sums of the powers 0 to 4 of a whole number weighted by n, as decimals.

    Sums of whole numbers do not depend on their order: partial profiles of any split of the rows merge
    by merge_sums to the same digits as the profile of all rows.
    """
    cut = values.filter(F.col(scaled).isNotNull()).select(*keys, F.col(n).cast("decimal(18,0)").alias("__n"), F.col(scaled).cast("bigint").alias("y"))
    cut = cut.withColumn("q", F.col("y") * F.col("y")).withColumns({"h": F.shiftright("q", 30), "l": F.col("q").bitwiseAND(F.lit((1 << 30) - 1))})
    return cut.groupBy(*keys).agg(*[F.sum(F.expr(p).cast("decimal(20,0)") * F.col("__n")).cast("decimal(38,0)").alias(c) for c, p in PARTS.items()])


def merge_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Power sums of the union of partial profiles."""
    return sums.groupBy(*keys).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in PARTS])


def moments(s0: Column, s1: Column, s2: Column, s3: Column, unit: Column) -> tuple[Column, Column, Column]:
    """Mean, variance and third central moment from exact sums of numbers counted in unit.

    The sums are moved to the whole number next to the mean before they leave whole numbers, so nothing
    cancels in doubles, however far the values are from zero.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    n = F.nullif(s0.cast("double"), F.lit(0.0))
    c = whole(F.floor(s1.cast("double") / n).cast("bigint"))
    c1 = whole(s1 - whole(c * s0))
    c2 = whole(s2 - whole(2 * whole(c * s1)) + whole(whole(c * c) * s0))
    c3 = whole(s3 - whole(3 * whole(c * s2)) + whole(3 * whole(whole(c * c) * s1)) - whole(whole(whole(c * c) * c) * s0))
    m1, m2, m3 = (x.cast("double") / n for x in (c1, c2, c3))
    return (c.cast("double") + m1) * unit, (m2 - m1 * m1) * unit * unit, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) * unit * unit * unit


def profile_loads(tables: dict[str, DataFrame], rules: Sequence[ColumnRule], load: str = "load_id") -> DataFrame:
    """One row per (table_name, column_name, load_id).

    rows, missing, bad, distinct values (as stored, of those not missing), min, max, exact power sums of
    the good values (s1, s2, s3 and the parts of s4, as whole numbers in units of the column's decimals;
    see power_sums), mean, stddev, skewness, exact median, the shares of missing and bad values, the
    distinct ratio, and the standardised difference of the mean against the column's other loads: the
    difference over the root of the mean variance, zero against one load alone or equal values. Good
    values of more than digits_of decimals are rounded to these for the power sums alone. Empty tables
    give no rows; a null load is a load of its own.
    """
    # the counts serve the statistics and the medians, so they are made once
    values = cut_lineage(reduce(DataFrame.unionByName, [column_values(tables[r.table], r, load) for r in rules]))
    keys = ["table_name", "column_name", "load_id"]
    x = F.col("number")
    digits = F.coalesce(*[F.when((F.col("table_name") == r.table) & (F.col("column_name") == r.column), digits_of(r)) for r in rules])
    stats = values.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("stored").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("stored").isNotNull() & x.isNull(), F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(x.isNotNull(), F.col("n")).otherwise(0)).alias("good"),
        F.count("stored").alias("distinct_values"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    sums = power_sums(values.withColumn("__y", F.round(x * F.pow(F.lit(10.0), digits)).cast("bigint")), keys, "__y", "n")
    median = range_quantiles(values, keys, "number", "n", {"median": 0.5})
    known = F.col("rows") - F.col("missing")
    out = stats.alias("a").join(sums.alias("s"), null_safe("a", "s", keys), "left").select("a.*", *[F.coalesce(f"s.{c}", F.lit(0).cast("decimal(38,0)")).alias(c) for c in PARTS])
    out = out.alias("a").join(median.alias("m"), null_safe("a", "m", keys), "left").select("a.*", "m.median")
    s3 = lambda high, low: (high * F.lit(1 << 30).cast("decimal(10,0)") + low).cast("decimal(38,0)")
    out = out.withColumns({"s3": s3(F.col("s3_high"), F.col("s3_low")), "digits": digits}).drop("s3_high", "s3_low")
    unit = F.pow(F.lit(10.0), -F.col("digits"))
    mean, var, third = moments(F.col("s0"), F.col("s1"), F.col("s2"), F.col("s3"), unit)
    out = out.select(
        "*",
        (F.col("missing") / F.col("rows")).alias("missing_share"),
        F.coalesce(F.col("bad") / F.nullif(known, F.lit(0)), F.lit(0.0)).alias("bad_share"),
        (F.col("distinct_values") / F.nullif(known, F.lit(0))).alias("distinct_ratio"),
        mean.alias("mean"), var.alias("__var"), third.alias("__third"),
    ).withColumns({"stddev": F.sqrt("__var"), "skewness": F.when(F.col("__var") > 0, F.col("__third") / F.pow("__var", F.lit(1.5)))})
    # a column has as many rows here as it has loads; sums of other loads are exact differences
    column = Window.partitionBy("table_name", "column_name")
    rest = [(F.sum(c).over(column) - F.col(c)).cast("decimal(38,0)") for c in ("s0", "s1", "s2", "s3")]
    rest_mean, rest_var, _ = moments(*rest, unit)
    out = out.withColumns({"__rest_mean": rest_mean, "__rest_var": rest_var})
    pooled = F.sqrt((F.col("__var") + F.col("__rest_var")) / 2)
    off = F.col("mean") - F.col("__rest_mean")
    return out.withColumn("standardised_difference", F.when(F.col("__rest_mean").isNull() & F.col("mean").isNotNull() | (off == 0), 0.0).otherwise(off / F.nullif(pooled, F.lit(0.0)))).drop("s0", "__var", "__third", "__rest_mean", "__rest_var")


def unusual_loads(
    profile: DataFrame, missing_off: float = 0.10, bad_above: float = 0.10, median_off: float = 0.30, distinct_below: float = 0.5, shift_above: float | None = None
) -> DataFrame:
    """(table_name, column_name, load_id, why): loads unlike the usual one of their column.

    Usual is the median over all loads. why joins missing, bad, median, distinct and shift, as they apply;
    shift is a mean more than shift_above standardised differences from that of the other loads, or unlike
    it where neither varies; it is looked at only if shift_above is given.
    """
    keys = ["table_name", "column_name"]
    column = Window.partitionBy(*keys)  # its loads
    half = lambda c: F.percentile(c, F.lit(0.5)).over(column)
    profile = profile.withColumns({"t_missing": half("missing_share"), "t_median": half("median"), "t_distinct": half("distinct_ratio")})
    flags = {
        "missing": F.abs(F.col("missing_share") - F.col("t_missing")) > missing_off + 1e-12,
        "bad": F.col("bad_share") > bad_above,
        "median": F.col("median").isNull() | (F.abs(F.col("median") - F.col("t_median")) > median_off * F.abs("t_median")),
        "distinct": F.col("distinct_ratio") < distinct_below * F.col("t_distinct"),
    }
    if shift_above is not None:
        flags["shift"] = F.col("mean").isNotNull() & ~F.coalesce(F.abs("standardised_difference") <= shift_above, F.lit(False))
    why = F.concat_ws("|", *[F.when(cond, F.lit(name)) for name, cond in flags.items()])
    return profile.withColumn("why", why).filter(F.length("why") > 0).select(*keys, "load_id", "why")
