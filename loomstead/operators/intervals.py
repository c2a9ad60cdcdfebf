"""Continuous periods and gaps of intervals per entity, by a merge within time shards and a stitch between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.skew import sharded_neighbour

SHARD_DAYS = 32


def _day(col):
    return F.datediff(F.col(col).cast("date"), F.lit("1970-01-01").cast("date"))


def covered_segments(
    df: DataFrame, entity: Sequence[str], start: str, end: str, shard_days: int = SHARD_DAYS
) -> DataFrame:
    """(entity, shard, seg_start, seg_end): disjoint covered stretches within each time shard of an entity.

    An interval without start or with an end before its start does not count; a null end equals the
    start; entities with a null key are left out. Intervals are clipped at shard borders. Equal starts
    are folded before anything is ordered, so what one task orders is bounded by the instants of a
    shard, not by the rows of an entity.
    """
    rows = (
        df.select(*entity, F.col(start).cast("timestamp_ntz").alias("__s"), F.col(end).cast("timestamp_ntz").alias("__e"))
        .withColumn("__e", F.coalesce("__e", "__s"))
        .filter(F.col("__s").isNotNull() & (F.col("__e") >= F.col("__s")))
    )
    for key in entity:
        rows = rows.filter(F.col(key).isNotNull())
    first = F.floor(_day("__s") / F.lit(shard_days)).cast("int")
    last = F.floor(_day("__e") / F.lit(shard_days)).cast("int")
    clipped = (
        rows.groupBy(*entity, "__s").agg(F.max("__e").alias("__e"))
        .withColumn("shard", F.explode(F.sequence(first, last)))
        .withColumn("__from", F.date_add(F.lit("1970-01-01").cast("date"), F.col("shard") * shard_days).cast("timestamp_ntz"))
        .withColumn("__to", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("shard") + 1) * shard_days).cast("timestamp_ntz"))
        .select(*entity, "shard", F.greatest("__s", "__from").alias("__s"), F.least("__e", "__to").alias("__e"))
        .groupBy(*entity, "shard", "__s").agg(F.max("__e").alias("__e"))
    )
    w = Window.partitionBy(*entity, "shard").orderBy("__s")
    reach = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("__s") <= reach, 0).otherwise(1)).over(w)
    return (
        clipped.withColumn("__i", island)
        .groupBy(*entity, "shard", "__i")
        .agg(F.min("__s").alias("seg_start"), F.max("__e").alias("seg_end"))
        .drop("__i")
    )


def gaps_from_segments(segments: DataFrame, entity: Sequence[str]) -> DataFrame:
    """(entity, shard, gap_start, gap_end): stretches between neighbouring segments that nothing covers."""
    seen = sharded_neighbour(segments, entity, "shard", ["seg_start"], ["seg_end"])
    return seen.filter(F.col("prev_seg_end") < F.col("seg_start")).select(
        *entity, "shard", F.col("prev_seg_end").alias("gap_start"), F.col("seg_start").alias("gap_end")
    )


def interval_gaps(df: DataFrame, entity: Sequence[str], start: str, end: str, shard_days: int = SHARD_DAYS) -> DataFrame:
    """(entity, gap_start, gap_end). Touching intervals leave no gap; an interval of no length parts one."""
    return gaps_from_segments(covered_segments(df, entity, start, end, shard_days), entity).drop("shard")


def continuous_periods(df: DataFrame, entity: Sequence[str], start: str, end: str, shard_days: int = SHARD_DAYS) -> DataFrame:
    """(entity, period_start, period_end): maximal covered periods, overlapping and touching intervals merged.

    A period opens where the segment before it does not reach, and closes with the last segment before
    the next opening; both neighbours come from the shard or, at its rim, from the shards' table of rims.
    """
    segments = covered_segments(df, entity, start, end, shard_days)
    opened = sharded_neighbour(segments, entity, "shard", ["seg_start"], ["seg_end"])
    openings = opened.filter(F.col("prev_seg_end").isNull() | (F.col("prev_seg_end") < F.col("seg_start"))).select(
        *entity, "shard", F.col("seg_start").alias("period_start"), F.col("prev_seg_end").alias("closed_before")
    )
    closing = sharded_neighbour(openings, entity, "shard", ["period_start"], ["closed_before"], lead=True)
    final = segments.groupBy(*entity).agg(F.max("seg_end").alias("__final"))
    return closing.join(final, list(entity)).select(
        *entity, "period_start", F.coalesce("next_closed_before", "__final").alias("period_end")
    )
