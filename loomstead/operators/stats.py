"""Statistics over groups: exact quantiles, rank correlation, trends, fences, resampling and greedy selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.profile import range_quantiles

from loomstead.operators.relational import average_rank


def quantile(c: Column | str, p: float) -> Column:
    """Exact quantile with linear interpolation; nulls do not count."""
    return F.percentile(c, F.lit(p))


def quartiles(df: DataFrame, group: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """q1, median and q3 per group from one sketch-free aggregate."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*group).agg(q.alias("__q")).select(*group, *[F.round(F.col("__q")[i], digits).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def median_of_medians(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str, name: str = "target") -> DataFrame:
    return df.groupBy(*outer, *inner).agg(F.median(value).alias("__m")).groupBy(*outer).agg(F.median("__m").alias(name))


def global_zscores(df: DataFrame, columns: Sequence[str], inverted: Sequence[str] = (), index: str = "index") -> DataFrame:
    """z_<column> of each column and their mean over those present; moments come from one aggregate, broadcast as one row."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__a_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    z = {f"z_{c}": (F.col(c) - F.col(f"__a_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) * (-1 if c in inverted else 1) for c in columns}
    out = out.withColumns(z)
    top = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in z), F.lit(0.0))
    n = sum((F.when(F.col(k).isNotNull(), 1).otherwise(0) for k in z), F.lit(0))
    return out.withColumn(index, top / F.nullif(n, F.lit(0))).select(*df.columns, *z, index)


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """rho per group from average ranks over complete pairs; null for fewer than least pairs or a side that does not vary."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.withColumn("__x", average_rank(x, group)).withColumn("__y", average_rank(y, group))
    agg = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pairs"), F.corr("__x", "__y").alias("__r"), F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1")
    )
    ok = (F.col("pairs") >= least) & (F.col("__x0") != F.col("__x1")) & (F.col("__y0") != F.col("__y1"))
    return agg.select(*group, "pairs", F.when(ok, F.col("__r")).alias("rho"))


def trend(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and r2 per group; null below three points, 0 where x or y does not vary."""
    p = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("__b"), F.regr_r2(y, x).alias("__r2"), F.var_pop(x).alias("__vx"), F.var_pop(y).alias("__vy")
    )
    flat = (F.col("__vx") == 0) | (F.col("__vy") == 0)
    return p.select(*group, "n", F.when(F.col("n") >= 3, F.when(flat, 0.0).otherwise(F.col("__b"))).alias("slope"), F.when(F.col("n") >= 3, F.when(flat, 0.0).otherwise(F.col("__r2"))).alias("r2"))


def within_fences(df: DataFrame, group: Sequence[str], columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """Rows whose columns all lie within width interquartile ranges of their group's quartiles."""
    q = df.groupBy(*group).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"__q_{c}") for c in columns])
    out = df.join(q, list(group))
    for c in columns:
        lo, hi = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        out = out.filter(F.col(c).between(lo - width * (hi - lo), hi + width * (hi - lo)))
    return out.drop(*[f"__q_{c}" for c in columns])


def robust_clamp(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, name: str = "capped") -> DataFrame:
    """value between its exact quantiles low and high over all rows; null stays null. The quantiles are found by value ranges."""
    numbers = df.select(F.lit(0).alias("k"), F.col(value).cast("double").alias("v"), F.lit(1).cast("bigint").alias("n"))
    caps = range_quantiles(numbers, ["k"], "v", "n", {"low": low, "high": high}).select(F.array("low", "high").alias("__cap"))
    caps = caps.unionByName(df.sparkSession.createDataFrame([(None,)], "__cap array<double>")).agg(F.max("__cap").alias("__cap"))
    return df.crossJoin(F.broadcast(caps)).withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col("__cap")[1]), F.col("__cap")[0]))).drop("__cap")


def bootstrap_interval(df: DataFrame, group: Sequence[str], x: str, y: str, seed: str, iterations: int = 160, least: int = 12) -> DataFrame:
    """Percentile interval (2.5 %, 97.5 %) of the rank correlation by resampling ranks, seeded per group; null below least pairs.

    A group is one analysis cell (a rating and a feature), of at most as many rows as there are counties.
    """
    schema = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group), "pairs bigint", "ci_low double", "ci_high double"])

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[g].iloc[0] for g in group]
        live = pdf[[x, y, seed]].dropna()
        n = len(live)
        low = high = float("nan")
        if n >= least:
            ranks = live[[x, y]].astype(float).sort_values([x, y]).rank(method="average").to_numpy()
            picks = np.random.default_rng(int(live[seed].iloc[0])).integers(0, n, size=(iterations, n))
            a, b = ranks[picks, 0], ranks[picks, 1]
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
            size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            rho = (a * b).sum(axis=1)[size > 0] / size[size > 0]
            if len(rho):
                low, high = (float(v) for v in np.quantile(rho, [0.025, 0.975]))
        return pd.DataFrame([[*head, n, low, high]], columns=[*group, "pairs", "ci_low", "ci_high"])

    return df.groupBy(*group).applyInPandas(resample, schema)


def spaced_peers(df: DataFrame, group: str, line: str, unit: str, rank: str, eligible: str, deviation: str, mean_deviation: str, count: int = 8) -> DataFrame:
    """For targets spread over 5..95 the nearest eligible line not taken yet, no unit twice; without eligible ones the least deviating line.

    The choice is sequential within a rating; a rating has one row per line.
    """
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, pick int, target double, `{line}` {df.schema[line].dataType.simpleString()}, `{unit}` {df.schema[unit].dataType.simpleString()}"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([line]).to_dict("records")
        out, lines, units = [], set(), set()
        big = lambda v: float("inf") if v is None or v != v else float(v)
        for k, target in enumerate(np.linspace(5, 95, count)):
            free = [r for r in rows if r[line] not in lines and r[unit] not in units]
            if not free:
                break
            strict = [r for r in free if r[eligible]]
            best = min(strict, key=lambda r: big(abs(r[rank] - target))) if strict else min(free, key=lambda r: (big(r[deviation]), big(r[mean_deviation]), big(abs(r[rank] - target)), r[line]))
            lines.add(best[line]), units.add(best[unit])
            out.append([pdf[group].iloc[0], k, float(target), best[line], best[unit]])
        return pd.DataFrame(out, columns=[group, "pick", "target", line, unit])

    return df.groupBy(group).applyInPandas(choose, schema)
