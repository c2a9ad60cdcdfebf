"""Profiles of coverage, missing values, distributions and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators.profile import range_quantiles
from loomstead.session import cut_lineage


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, rows, nulls, null_pct): one aggregate over the table, then one row per column."""
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"__n_{c}") for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__n_{c}").alias("nulls")) for c in columns])
    return agg.select("rows", F.explode(items).alias("x")).select("x.column_name", "rows", "x.nulls", (F.col("x.nulls") * 100.0 / F.nullif(F.col("rows"), F.lit(0))).alias("null_pct"))


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes, exact percentiles by value ranges and the number beyond 1.5 interquartile ranges, per column."""
    ps = (0.01, 0.25, 0.5, 0.75, 0.99)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "v").filter(F.col("v").isNotNull())
    base = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    at = {f"p{int(p * 100):02d}": p for p in ps}
    quantiles = range_quantiles(long.withColumn("n", F.lit(1).cast("bigint")), ["column_name"], "v", "n", at)
    quantiles = cut_lineage(quantiles.select("column_name", F.array(*at).alias("q")))
    base = base.join(F.broadcast(quantiles), "column_name")
    iqr = F.col("q")[3] - F.col("q")[1]
    # one row per column is broadcast
    far = long.join(F.broadcast(quantiles), "column_name").groupBy("column_name").agg(
        F.count_if((F.col("v") < F.col("q")[1] - 1.5 * iqr) | (F.col("v") > F.col("q")[3] + 1.5 * iqr)).alias("outliers")
    )
    return base.join(far, "column_name").select("column_name", "n", "mean", "std", "min", "max", *[F.col("q")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(ps)], "outliers")


def correlation_pairs(df: DataFrame, columns: Sequence[str], least_pairs: int = 100, top: int = 30) -> DataFrame:
    """The strongest pairwise correlations; all pairs of columns come from one aggregate."""
    pairs = list(combinations(columns, 2))
    agg = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"__r{i}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"__n{i}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"__n{i}").alias("pairs"), F.col(f"__r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    out = agg.select(F.explode(rows).alias("x")).select("x.*").filter((F.col("pairs") >= least_pairs) & F.col("r").isNotNull())
    return out.orderBy(F.abs("r").desc(), "column_a", "column_b").limit(top)


def coverage(df: DataFrame, period: str, unit: str, flags: Sequence[str]) -> DataFrame:
    """Units per period and the percentage of rows with each flag."""
    return df.groupBy(period).agg(F.countDistinct(unit).alias("units"), *[(F.avg(F.col(f).cast("int")) * 100).alias(f"{f}_pct") for f in flags])


def duplicate_columns(df: DataFrame, pairs: Sequence[tuple[str, str]], chunk: int = 100) -> list[str]:
    """Second columns of pairs that equal the first in every row where it has a value; one aggregate per chunk of pairs."""
    out = []
    for at in range(0, len(pairs), chunk):
        part = pairs[at : at + chunk]
        row = df.agg(*[x for i, (a, b) in enumerate(part) for x in (F.count_if(F.col(b).isNotNull()).alias(f"v{i}"), F.count_if(F.col(b).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))).alias(f"d{i}"))]).first()
        out += [b for i, (_, b) in enumerate(part) if row[f"v{i}"] and not row[f"d{i}"]]
    return out
