"""Joins and neighbour look-ups that keep their balance when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in this many of all rows; its rows are split into parts of about that size.
PARTS_OF_ALL = 2000
#: Keys of no more rows are never split.
SMALL_KEY = 1000


def hot_keys(counts: DataFrame, keys: Sequence[str], count_col: str) -> DataFrame:
    """(keys, __parts): the keys that hold more than one in PARTS_OF_ALL of all rows, with the parts to split them into.

    There are at most PARTS_OF_ALL of them, whatever the size of the data, and together they have at most
    twice as many parts of about one in PARTS_OF_ALL of all rows each.
    """
    total = counts.agg(F.sum(count_col).alias("__total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .filter(F.col(count_col) * F.lit(PARTS_OF_ALL) > F.col("__total"))
        .filter(F.col(count_col) > SMALL_KEY)
        .select(*keys, F.ceil(F.col(count_col) * F.lit(PARTS_OF_ALL) / F.col("__total")).cast("int").alias("__parts"))
    )


def skew_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], count_col: str, spread_by: Sequence[str], how: str = "left", counts: DataFrame | None = None
) -> DataFrame:
    """Join rows to a lookup that is unique by keys, splitting keys that hold a large share of the rows.

    count_col is the number of rows of a key, in the lookup or, if given, in counts, which need not hold
    the other columns of the lookup. Rows of hot_keys are salted and the lookup repeats these keys once
    for each part. Null keys match nothing.
    """
    hot = F.broadcast(hot_keys(lookup if counts is None else counts, keys, count_col))
    salt = F.pmod(F.xxhash64(*spread_by), F.col("__parts")).cast("int")
    left = rows.join(hot, list(keys), "left").withColumn("__salt", F.coalesce(salt, F.lit(0)))
    right = lookup.join(hot, list(keys), "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))
    )
    return (
        left.drop("__parts").join(right.drop("__parts", count_col), [*keys, "__salt"], how).drop("__salt")
    )


def sharded_neighbour(
    df: DataFrame, entity: Sequence[str], shard: str, order: Sequence[str], values: Sequence[str], lead: bool = False
) -> DataFrame:
    """Add prev_<value> (or next_<value>) in the order of an entity without gathering the entity in one task.

    Rows must be ordered by shard first, then by order. What a shard sees across its rim is found from one
    row per (entity, shard), by an aggregate that combines before it shuffles, and enters the shard as a
    row before its first (after its last) one, so each (entity, shard) is ordered once and nothing is
    joined. Null entities are one entity; rows of equal order stand in any order.
    """
    name = "next" if lead else "prev"
    packed = F.struct(*[F.col(v) for v in values])
    ends = F.min if lead else F.max
    rims = df.groupBy(*entity, shard).agg(ends(F.struct(F.struct(*order).alias("o"), packed.alias("v"))).alias("__rim"))
    step = F.lead if lead else F.lag
    far = rims.withColumn("__far", step("__rim.v").over(Window.partitionBy(*entity).orderBy(shard)))
    guest = far.filter("__far is not null").select(*entity, shard, F.lit(True).alias("__guest"), F.col("__far").alias("__v"))
    rows = df.withColumn("__guest", F.lit(False)).withColumn("__v", packed)
    both = rows.unionByName(guest, allowMissingColumns=True)
    first = F.col("__guest").asc() if lead else F.col("__guest").desc()
    near = step("__v").over(Window.partitionBy(*entity, shard).orderBy(first, *order))
    return (
        both.withColumn("__near", near)
        .filter(~F.col("__guest"))
        .withColumns({f"{name}_{v}": F.col("__near")[v] for v in values})
        .drop("__near", "__guest", "__v")
    )
