"""Filling missing cells by label propagation over groups of like records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.skew import skew_join
from loomstead.session import cut_lineage

MISSING_AT_OR_BELOW = -100_000_000.0


def is_missing_number(col: Column, floor: float = MISSING_AT_OR_BELOW) -> Column:
    """Null, NaN, or a provider code at or below floor."""
    c = col.cast("double")
    return c.isNull() | F.isnan(c) | (c <= floor)


def propagate_numbers(
    df: DataFrame,
    row_id: str,
    columns: Sequence[str],
    hubs: Sequence[Sequence[str]],
    hub_weights: Sequence[float] | None = None,
    rounds: int = 3,
    floor: float = MISSING_AT_OR_BELOW,
) -> DataFrame:
    """Long table (row_id, column_name, value, filled, hops) of the missing numeric cells of df.

    Records that agree on the keys of a hub are neighbours. Observed cells are clamped; a missing cell
    takes the weighted mean of its hubs' means, in which cells filled before count with their estimate,
    for a fixed number of rounds. Records with the same keys in every hub have the same neighbours, so
    the propagation runs over distinct key combinations (cells), never over pairs of records.

    hops is 1 where an observed value shares a hub with the cell, otherwise the round in which the
    filling reached it; a cell never reached has value null, filled false and hops null. A hub with a
    null key joins nobody. Ties do not arise (means); repeated rows weigh as often as they occur; an
    empty table gives an empty result. Other columns of df are not read.
    """
    weights = list(hub_weights or [1.0] * len(hubs))
    keys = list(dict.fromkeys(k for h in hubs for k in h))
    kn = {k: f"__k{i}" for i, k in enumerate(keys)}
    hub_keys = [[kn[k] for k in h] for h in hubs]
    cell_keys = [kn[k] for k in keys]
    base = df.select(
        F.col(row_id).alias("__row"),
        *[F.col(k).alias(kn[k]) for k in keys],
        *[
            F.when(~is_missing_number(F.col(c), floor), F.col(c).cast("double")).alias(f"__v{j}")
            for j, c in enumerate(columns)
        ],
    )
    n = len(columns)
    # unreached keys stay apart: cells are told apart with nulls kept, hubs drop them
    cells = base.groupBy(*cell_keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[x for j in range(n) for x in (F.sum(f"__v{j}").alias(f"__s{j}"), F.count(f"__v{j}").alias(f"__n{j}"))],
    )
    cells = cut_lineage(
        cells.select(
            *cell_keys,
            "__rows",
            *[F.coalesce(f"__s{j}", F.lit(0.0)).alias(f"__s{j}") for j in range(n)],
            *[f"__n{j}" for j in range(n)],
            *[F.lit(None).cast("double").alias(f"__f{j}") for j in range(n)],
            *[F.lit(None).cast("int").alias(f"__h{j}") for j in range(n)],
        )
    )
    for turn in range(1, rounds + 1):
        joined = cells
        for h, hk in enumerate(hub_keys):
            hub = (
                reduce(lambda d, k: d.filter(F.col(k).isNotNull()), hk, cells)
                .groupBy(*hk)
                .agg(
                    *[
                        x
                        for j in range(n)
                        for x in (
                            F.sum(F.col(f"__s{j}") + F.coalesce((F.col("__rows") - F.col(f"__n{j}")) * F.col(f"__f{j}"), F.lit(0.0))).alias(f"__hs{h}_{j}"),
                            F.sum(F.col(f"__n{j}") + F.when(F.col(f"__f{j}").isNotNull(), F.col("__rows") - F.col(f"__n{j}")).otherwise(0)).alias(f"__hn{h}_{j}"),
                        )
                    ]
                )
            )
            joined = joined.join(hub, hk, "left")
        new = {}
        for j in range(n):
            parts = [
                (F.when(F.col(f"__hn{h}_{j}") > 0, F.lit(w) * F.col(f"__hs{h}_{j}") / F.col(f"__hn{h}_{j}")),
                 F.when(F.col(f"__hn{h}_{j}") > 0, F.lit(w)))
                for h, w in enumerate(weights)
            ]
            top = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v, _ in parts])
            low = reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0.0)) for _, w in parts])
            value = F.when((F.col("__rows") > F.col(f"__n{j}")) & (low > 0), top / F.nullif(low, F.lit(0.0)))
            new[f"__f{j}"] = value
            new[f"__h{j}"] = F.coalesce(F.col(f"__h{j}"), F.when(value.isNotNull(), F.lit(turn)))
        cells = joined.select(
            *cell_keys, "__rows", *[f"__s{j}" for j in range(n)], *[f"__n{j}" for j in range(n)],
            *[e.alias(k) for k, e in new.items()],
        )
        if turn < rounds:
            cells = cut_lineage(cells)
    # null keys meet their cell again through a text that tells null from any value
    code = F.to_json(F.struct(*cell_keys))
    wanted = base.withColumn("__code", code).select(
        "__row", "__code",
        F.explode(F.filter(F.array(*[F.when(F.col(f"__v{j}").isNull(), F.lit(j)) for j in range(n)]), lambda x: x.isNotNull())).alias("__j"),
    )
    lookup = cells.select(
        code.alias("__code"), "__rows",
        F.array(*[F.col(f"__f{j}") for j in range(n)]).alias("__fs"),
        F.array(*[F.col(f"__h{j}") for j in range(n)]).alias("__hs"),
    ).filter(F.exists("__hs", lambda x: x.isNotNull()))
    names = F.array(*[F.lit(c) for c in columns])
    return skew_join(wanted, lookup, ["__code"], "__rows", ["__row"]).select(
        F.col("__row").alias(row_id),
        F.get(names, F.col("__j")).alias("column_name"),
        F.get("__fs", F.col("__j")).alias("value"),
        F.get("__fs", F.col("__j")).isNotNull().alias("filled"),
        F.get("__hs", F.col("__j")).alias("hops"),
    )


def propagate_categories(
    df: DataFrame, row_id: str, column: str, hubs: Sequence[Sequence[str]], rounds: int = 2
) -> DataFrame:
    """(row_id, value, share, hops) of the missing (null or blank) cells of a categorical column.

    Each hub keeps a distribution over categories; a missing cell takes the mean of its hubs'
    distributions, in which cells filled before take part, and in the end the most likely category, at
    equal shares the smallest. Observed cells are clamped. Cells no hub reaches are left out.
    """
    keys = list(dict.fromkeys(k for h in hubs for k in h))
    kn = {k: f"__k{i}" for i, k in enumerate(keys)}
    cell_keys = list(kn.values())
    base = df.select(
        F.col(row_id).alias("__row"),
        F.to_json(F.struct(*[F.col(k).alias(kn[k]) for k in keys])).alias("__code"),
        *[F.col(k).alias(kn[k]) for k in keys],
        F.when(F.trim(column) != "", F.col(column)).alias("__c"),
    )
    counts = base.groupBy("__code", *cell_keys, "__c").agg(F.count(F.lit(1)).cast("double").alias("__w"))
    counts = cut_lineage(counts)
    observed = counts.filter(F.col("__c").isNotNull())
    gaps = counts.filter(F.col("__c").isNull()).select("__code", *cell_keys, F.col("__w").alias("__missing"))
    filled = None
    for turn in range(1, rounds + 1):
        mass = observed.select(*cell_keys, "__c", "__w")
        if filled is not None:
            mass = mass.unionByName(filled.select(*cell_keys, "__c", (F.col("__p") * F.col("__missing")).alias("__w")))
        votes = []
        for h in hubs:
            hk = [kn[k] for k in h]
            live = reduce(lambda d, k: d.filter(F.col(k).isNotNull()), hk, mass)
            per = live.groupBy(*hk, "__c").agg(F.sum("__w").alias("__w"))
            tot = live.groupBy(*hk).agg(F.sum("__w").alias("__t"))
            votes.append(gaps.join(per, hk).join(tot, hk).select("__code", *cell_keys, "__missing", "__c", (F.col("__w") / F.col("__t")).alias("__p")))
        summed = reduce(DataFrame.unionByName, votes).groupBy("__code", *cell_keys, "__missing", "__c").agg(F.sum("__p").alias("__p"))
        norm = summed.groupBy("__code").agg(F.sum("__p").alias("__z"))
        fresh = summed.join(norm, "__code").withColumn("__p", F.col("__p") / F.col("__z")).drop("__z")
        if filled is None:
            fresh = fresh.withColumn("__hops", F.lit(1))
        else:
            known = filled.select("__code", F.col("__hops").alias("__old")).distinct()
            fresh = fresh.join(known, "__code", "left").withColumn("__hops", F.coalesce("__old", F.lit(turn))).drop("__old")
        filled = cut_lineage(fresh)
    best = filled.groupBy("__code").agg(
        F.min(F.struct((-F.round("__p", 12)).alias("p"), F.col("__c").alias("c"), F.col("__hops").alias("h"))).alias("__b"),
        F.max("__missing").cast("long").alias("__rows"),
    )
    missing = base.filter(F.col("__c").isNull()).select("__row", "__code")
    return skew_join(missing, best, ["__code"], "__rows", ["__row"], "inner").select(
        F.col("__row").alias(row_id), F.col("__b.c").alias("value"), (-F.col("__b.p")).alias("share"), F.col("__b.h").alias("hops")
    )
