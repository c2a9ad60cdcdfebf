"""Groups of records linked directly or indirectly, by graph reduction: strip, compress, solve the core, restore."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators.skew import skew_join
from loomstead.session import cut_lineage

SHRINK = 0.25
#: What is left of the core is solved by one task once it has no more edges than this.
CORE_EDGES = 20_000


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _strip_and_compress(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(removed (vertex, parent), edges left): one round over leaves and chains.

    A vertex of degree one or two knows its neighbours from the minimum and maximum of its edges. Among
    adjacent ones, that of the lower degree, then of the lower hash in this round, is removed: a leaf
    goes with its edge; a chain vertex is spliced out and its neighbours are joined, as in list ranking by
    independent sets. Nothing is joined by a vertex of high degree: edges are matched as pairs, so a hub
    with a third of all edges stays spread.
    """
    info = _both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("n1"), F.max("v").alias("n2"))
    low = info.filter("deg <= 2").withColumn("rank", F.struct(F.col("deg"), F.xxhash64(F.col("u"), F.lit(f"strip {turn}")), F.col("u")))
    near = low.select("u", "rank", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("n"))
    blocked = (
        near.groupBy(F.least("u", "n").alias("a"), F.greatest("u", "n").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("rank", "u")).alias("worse"))
        .filter("c = 2").select(F.col("worse.u").alias("u")).distinct()
    )
    gone = cut_lineage(low.drop("rank").join(blocked, "u", "left_anti"))
    cut = gone.select("u", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("n")).select(F.least("u", "n").alias("u"), F.greatest("u", "n").alias("v"))
    spliced = gone.filter("deg = 2").select(F.col("n1").alias("u"), F.col("n2").alias("v"))
    left = _canonical(edges.join(cut, ["u", "v"], "left_anti").unionByName(spliced))
    return gone.select(F.col("u").alias("vertex"), F.col("n1").alias("parent")), cut_lineage(left)


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(removed (vertex, parent), edges left): every vertex of the core is taken for the least hash of its closed neighbourhood.

    Whatever vertex of its group each one is taken for, the edges between these link what was linked, so
    one step needs no roots; with three and more neighbours each, few vertices are the least of any
    neighbourhood. A vertex that others are taken for stays, by its own name, in the edges left.
    """
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(f"core {turn}")).alias("h"), F.col(c).alias("id"))
    info = _both_ways(edges).groupBy("u").agg(F.min(order("v")).alias("best"), F.count(F.lit(1)).alias("deg"))
    info = cut_lineage(info.select("u", "deg", F.least(F.col("best"), order("u"))["id"].alias("to")))
    moved = edges
    for end, other in (("u", "v"), ("v", "u")):
        lookup = info.select(F.col("u").alias(end), F.col("to").alias("__to"), "deg")
        moved = skew_join(moved, lookup, [end], "deg", [other], "inner").select(F.col("__to").alias(end), other)
    gone = info.filter("u != to").select(F.col("u").alias("vertex"), F.col("to").alias("parent"))
    gone = gone.join(info.select(F.col("to").alias("vertex")).distinct(), "vertex", "left_anti")
    return gone, cut_lineage(_canonical(moved))


def _solve(edges: DataFrame) -> DataFrame:
    """(vertex, label) of a core of at most CORE_EDGES edges, by union of sets in one task; vertices that are labels are left out."""

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[y]
            return x

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                a, b = top(u), top(v)
                up[max(a, b)] = min(a, b)
        out = [(x, t) for x in up if (t := top(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], names=["vertex", "label"])

    return edges.coalesce(1).mapInArrow(solved, "vertex bigint, label bigint")


def connected_groups(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(vertex, group_id) for every vertex (bigint) with an edge to another one; group_id is the least vertex of its group.

    Edges with a null end and loops link nothing; repeated and reversed edges count once; an empty table
    gives an empty one. The rounds strip degree-one vertices and compress degree-two chains while that
    removes a share of SHRINK of the edges, then contract the core until one task can solve it. Then the
    rounds are undone from the last to the first: a removed vertex has the label of the vertex it points
    at, which was removed later or never. Every vertex is labelled once. Every round's tables are written
    to the shared folder.
    """
    rest = cut_lineage(_canonical(edges.select(F.col(left).cast("bigint").alias("u"), F.col(right).cast("bigint").alias("v"))))
    rounds: list[DataFrame] = []
    size = rest.count()
    core = False
    while size > CORE_EDGES or size and not core:
        gone, rest = _contract(rest, len(rounds)) if core else _strip_and_compress(rest, len(rounds))
        rounds.append(gone)
        before, size = size, rest.count()
        # what hardly shrinks any more is the core
        core = core or before - size < SHRINK * before
    labels = cut_lineage(_solve(rest))
    for gone in reversed(rounds):
        children = gone.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        found = skew_join(gone, labels.withColumnRenamed("vertex", "parent"), ["parent"], "n", ["vertex"], counts=children)
        labels = labels.unionByName(cut_lineage(found.select("vertex", F.coalesce("label", "parent").alias("label"))))
    everyone = labels.unionByName(labels.select(F.col("label").alias("vertex"), "label").distinct())
    least = cut_lineage(everyone.groupBy("label").agg(F.min("vertex").alias("group_id"), F.count(F.lit(1)).alias("n")))
    return skew_join(everyone, least, ["label"], "n", ["vertex"], "inner").select("vertex", "group_id")


def shared_name_edges(names: DataFrame, scope: list[str], vertex: str) -> DataFrame:
    """(u, v): each row's vertex with the least vertex that names the same thing, a star per name instead of all pairs."""
    least = names.groupBy(*scope).agg(F.min(vertex).alias("v"), F.count(F.lit(1)).alias("__n"))
    # a name of one row links nothing
    least = cut_lineage(least.filter("__n > 1"))
    return skew_join(names.select(*scope, F.col(vertex).alias("u")), least, scope, "__n", ["u"], "inner").select("u", "v").filter("u != v")
