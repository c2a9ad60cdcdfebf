"""Filling containers of fixed capacity: best fit over a histogram of lengths, then slots by rank within length."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.session import cut_lineage

ROWS_PER_RANK_PART = 200_000


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(copies, {length: items per container})]: containers that hold every item of the histogram once.

    The longest length left opens a container, which then takes, again and again, the longest length left
    that still fits (the best fit, as it leaves the least room). The same content is repeated as often as
    the counts allow, so the work depends on the number of lengths, at most capacity, not on the items.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    lengths = sorted(left)
    plan = []
    while lengths:
        content: dict[int, int] = {}
        room = capacity
        at = len(lengths)
        while room:
            at = bisect_right(lengths, room, 0, at)
            while at and content.get(lengths[at - 1], 0) >= left[lengths[at - 1]]:
                at -= 1
            if not at:
                break
            n = lengths[at - 1]
            take = min(room // n, left[n] - content.get(n, 0))
            content[n] = content.get(n, 0) + take
            room -= n * take
        copies = min(left[n] // k for n, k in content.items())
        plan.append((copies, content))
        for n, k in content.items():
            left[n] -= copies * k
            if not left[n]:
                del left[n]
                del lengths[bisect_right(lengths, n) - 1]
    return plan


def pack_items(sizes: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(container_id, item, piece_no, piece_start, piece_size): every item with a positive size placed exactly once.

    An item over the capacity is split into full containers of its own and a rest, which is placed like
    any item; no other item is split. Items of null or non-positive size are not placed. Items of one
    length are exchangeable, so only counts are planned (at most capacity lengths on the driver); each
    item then takes the slot of its rank among the items of its length. Ranks are counted in salted
    parts, so a length that most items have is no task of its own. Repeated rows are items of their own.
    """
    long = F.col("__n") > capacity
    base = sizes.select(F.col(item).alias("__item"), F.col(size).cast("bigint").alias("__n")).filter("__n > 0")
    pieces = base.withColumn("__k", F.explode(F.sequence(F.lit(0), F.when(long, F.floor((F.col("__n") - 1) / capacity).cast("int")).otherwise(0))))
    pieces = cut_lineage(
        pieces.select(
            "__item", F.col("__k").cast("int").alias("piece_no"), (F.col("__k") * capacity).cast("bigint").alias("piece_start"),
            F.least(F.lit(capacity), F.col("__n") - F.col("__k") * capacity).cast("int").alias("piece_size"),
        )
    )
    # a length that all items have is still counted in parts of bounded size
    salts = max(16, -(-pieces.count() // ROWS_PER_RANK_PART))
    pieces = pieces.withColumn("__salt", F.pmod(F.xxhash64("__item", "piece_no"), F.lit(salts)))
    parts = pieces.groupBy("piece_size", "__salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["piece_size"]: r["n"] for r in parts.groupBy("piece_size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = plan_containers(counts, capacity)
    used: dict[int, int] = {}
    rows, first = [], 0
    for copies, content in plan:
        for n, k in content.items():
            begin = used.get(n, 0)
            rows.append((n, begin, begin + copies * k, first, k))
            used[n] = begin + copies * k
        first += copies
    spark = sizes.sparkSession
    # one row per planned content and length: bounded by the lengths, not by the items
    slots = spark.createDataFrame(rows, "piece_size int, __from bigint, __until bigint, __first bigint, __per int")
    offsets = parts.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy("piece_size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = (
        pieces.withColumn("__r", F.row_number().over(Window.partitionBy("piece_size", "__salt").orderBy("__item", "piece_no")) - 1)
        .join(offsets, ["piece_size", "__salt"])
        .withColumn("__rank", F.col("__before") + F.col("__r"))
    )
    placed = ranked.join(F.broadcast(slots), (ranked["piece_size"] == slots["piece_size"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__until")))
    return placed.select(
        (F.col("__first") + F.floor((F.col("__rank") - F.col("__from")) / F.col("__per"))).cast("bigint").alias("container_id"),
        F.col("__item").alias(item), "piece_no", "piece_start", ranked["piece_size"],
    )
