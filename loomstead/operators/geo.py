"""Exact operations on rings of coordinates that need no geometry library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_area(ring: Column) -> Column:
    """Shoelace area of array<array<double>>: positive if the points run anticlockwise."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i)
    terms = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(at(i), F.lit(0)) * F.get(at(i + 1), F.lit(1)) - F.get(at(i + 1), F.lit(0)) * F.get(at(i), F.lit(1)))
    return F.when(n >= 3, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2).otherwise(F.lit(0.0))


def oriented(ring: Column, anticlockwise: bool = False) -> Column:
    area = signed_area(ring)
    return F.when((area < 0) if anticlockwise else (area > 0), F.reverse(ring)).otherwise(ring)


def exterior_rings(polygons: Column) -> Column:
    """The first ring of each polygon of a multipolygon: interior rings are dropped."""
    return F.transform(polygons, lambda p: F.slice(p, 1, 1))
