"""One surviving value per field of each group of duplicate records, by currency reasoning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.skew import sharded_neighbour
from loomstead.session import cut_lineage

SMALL = 32
SUPPORT = 5
MARGIN = 0.2


def valid_amount(c: Column) -> Column:
    """Not null, not NaN, not negative."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (c >= 0)


def value_class(c: Column) -> Column:
    """At most SMALL + 64 classes of non-negative numbers: small whole numbers one by one, the others by power of two."""
    c = c.cast("double")
    power = F.least(F.floor(F.log2(F.greatest(c, F.lit(1.0)))), F.lit(63)).cast("int") + SMALL
    return F.when((c < SMALL) & (c == F.floor(c)), c.cast("int")).otherwise(power)


def _long(df: DataFrame, group: Sequence[str], record_id: str, loaded_at: str, fields: Sequence[str], valid) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.when(valid(F.col(f)), F.col(f).cast("double")).alias("value")) for f in fields])
    return (
        df.select(*group, F.col(record_id).alias("__rid"), F.col(loaded_at).alias("__at"), F.explode(cells).alias("__c"))
        .select(*group, "__rid", "__at", F.col("__c.field").alias("field_name"), F.col("__c.value").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def learn_precedence(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(field_name, earlier, later): classes of values that follow each other in one direction in timestamped rows.

    Transitions are those between neighbouring deliveries of a group. A pair of classes is ordered if it
    was seen SUPPORT times and one direction outweighs the other by MARGIN of the sightings. The table is
    bounded by the classes, whatever the data.
    """
    # what is learned are counts over all groups, so a hash may stand for the group; values of a class at one
    # instant count once, so an hour of a group holds no more rows than it has seconds and classes
    timed = (
        cells.filter(F.col("__at").isNotNull())
        .select(F.xxhash64(*group, "field_name").alias("__cell"), "field_name", "__at", value_class(F.col("value")).alias("cls"))
        .distinct()
        .withColumn("__shard", F.floor(F.unix_seconds(F.col("__at").cast("timestamp")) / 3600))
    )
    steps = sharded_neighbour(timed, ["__cell"], "__shard", ["__at", "cls"], ["cls"])
    steps = steps.filter(F.col("prev_cls").isNotNull() & (F.col("prev_cls") != F.col("cls")))
    pair = steps.groupBy("field_name", F.least("prev_cls", "cls").alias("a"), F.greatest("prev_cls", "cls").alias("b")).agg(
        F.sum(F.when(F.col("cls") > F.col("prev_cls"), 1).otherwise(-1)).alias("balance"), F.count(F.lit(1)).alias("n")
    )
    sure = pair.filter((F.col("n") >= SUPPORT) & (F.abs("balance") >= MARGIN * F.col("n")))
    up = F.col("balance") > 0
    return sure.select("field_name", F.when(up, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("later"))


def close_precedence(order: DataFrame) -> DataFrame:
    """(field_name, earlier, later) closed over all steps; classes that follow each other in a circle have no order.

    A field has at most as many rows as pairs of classes, so one task closes it.
    """
    def closed(pairs: pa.Table) -> pa.Table:
        after: dict[int, set[int]] = {}
        for a, b in zip(pairs["earlier"].to_pylist(), pairs["later"].to_pylist()):
            after.setdefault(a, set()).add(b)
        for mid in list(after):
            for a in after:
                if mid in after[a]:
                    after[a] |= after[mid]
        sure = [(a, b) for a in sorted(after) for b in sorted(after[a]) if a not in after.get(b, ())]
        name = pairs["field_name"][0].as_py()
        columns = list(zip(*[(name, a, b) for a, b in sure])) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, pairs.schema)], schema=pairs.schema)

    order = order.select("field_name", "earlier", "later")
    return order.groupBy("field_name").applyInArrow(closed, order.schema)


def surviving_values(
    df: DataFrame, group: Sequence[str], record_id: str, loaded_at: str, fields: Sequence[str],
    valid: Callable[[Column], Column] = valid_amount,
) -> DataFrame:
    """(group_id, field_name, record_id, value, evidence, timed_value) of every group of two or more records.

    group_id is the smallest record_id of the group. Of the valid values of a field the one loaded last
    survives; at equal times that of the smallest record_id. Values without a time enter through learned
    currency: the classes of a group's untimed values and of its latest timed value are ordered by the
    precedence learned from all timestamped rows; the latest timed value survives unless an untimed class
    is known to follow it, and the topologically last class wins (no known successor in the group; among
    several, the smallest record_id). Where the learned order runs in a circle nothing is known, and the
    timed value, else the smallest record_id, stands. evidence is time or currency; timed_value is the
    latest value that has a time. A field without valid
    values gives no row. Rows with a null in a group column form no group. Repeated rows count as records.

    A group's rows are reduced to maxima and to one row per class before any of them meet.
    """
    rows = df.select(*group, record_id, loaded_at, *fields)
    for g in group:
        rows = rows.filter(F.col(g).isNotNull())
    # read by the maxima, the learning and the untimed values, so the groups' keys are made once
    rows = cut_lineage(rows)
    at = F.col(loaded_at)
    rid = F.col(record_id)
    newest = [
        F.max(F.when(valid(F.col(f)) & at.isNotNull(), F.struct(at.alias("at"), (-rid).alias("r"), F.col(f).cast("double").alias("v")))).alias(f"__m{i}")
        for i, f in enumerate(fields)
    ]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.min(rid).alias("group_id"), *newest).filter("__n > 1")
    timed = groups.select(
        *group, "group_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"__m{i}").alias("m")) for i, f in enumerate(fields)])).alias("__c"),
    ).select(*group, "group_id", F.col("__c.field_name").alias("field_name"), (-F.col("__c.m.r")).alias("t_rid"), F.col("__c.m.v").alias("t_value"))

    cells = _long(rows, group, record_id, loaded_at, fields, valid)
    untimed = (
        cells.filter(F.col("__at").isNull())
        .groupBy(*group, "field_name", value_class(F.col("value")).alias("cls"))
        .agg(F.min(F.struct(F.col("__rid").alias("rid"), "value")).alias("best"))
        .groupBy(*group, "field_name")
        .agg(F.collect_list(F.struct("cls", F.col("best.rid").alias("rid"), F.col("best.value").alias("value"))).alias("nodes"))
    )
    order = close_precedence(learn_precedence(cells, group)).groupBy("field_name").agg(F.collect_list(F.struct("earlier", "later")).alias("order"))
    latest = F.when(F.col("t_rid").isNotNull(), F.struct(value_class(F.col("t_value")).alias("cls"), F.col("t_rid").alias("rid"), F.col("t_value").alias("value")))
    joined = timed.join(untimed, [*group, "field_name"], "left").join(F.broadcast(order), "field_name", "left")
    own = F.filter(F.array_distinct(F.transform("__all", lambda x: x["cls"])), lambda c: c.isNotNull())
    joined = (
        joined.withColumn("__t", latest)
        .withColumn("__all", F.filter(F.concat(F.array("__t"), F.coalesce("nodes", F.array().cast("array<struct<cls:int,rid:bigint,value:double>>"))), lambda x: x.isNotNull()))
        .withColumn("__classes", own)
        .withColumn(
            "__known",
            F.when(F.col("nodes").isNotNull(), F.filter(F.coalesce("order", F.array().cast("array<struct<earlier:int,later:int>>")), lambda o: F.array_contains("__classes", o["earlier"]) & F.array_contains("__classes", o["later"]))),
        )
        .withColumn("__tops", F.filter("__all", lambda x: ~F.exists(F.coalesce("__known", F.array().cast("array<struct<earlier:int,later:int>>")), lambda o: o["earlier"] == x["cls"])))
    )
    rank = lambda xs: F.array_min(F.transform(xs, lambda x: F.struct(x["rid"].alias("rid"), x["value"].alias("value"))))
    timed_on_top = F.exists("__tops", lambda x: x["rid"] == F.col("t_rid"))
    stand = F.when(F.col("__t").isNotNull(), F.struct(F.col("t_rid").alias("rid"), F.col("t_value").alias("value"))).otherwise(rank(F.col("__all")))
    pick = F.when(timed_on_top | (F.size("__tops") == 0), stand).otherwise(rank(F.col("__tops")))
    return (
        joined.filter(F.size("__all") > 0)
        .withColumn("__p", pick)
        .select(
            "group_id", "field_name", F.col("__p.rid").alias("record_id"), F.col("__p.value").alias("value"),
            F.when(F.col("__p.rid") == F.col("t_rid"), "time").otherwise("currency").alias("evidence"),
            F.col("t_value").alias("timed_value"),
        )
    )
