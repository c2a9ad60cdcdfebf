"""Event records without a start are kept as incidents of their own."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomstead.plans.marts import _events


@pytest.mark.parametrize("name,source", [("canonical_incidents", "fema"), ("storm_episodes", "noaa"), ("canonical_events", None)])
def test_undated_records_are_kept(spark, name, source):
    sf = "/root/testdata/sf0.01"
    e = _events(spark, sf).filter(F.col("__source") == source if source else F.col("__source").isin("fema", "noaa"))
    lost = e.filter("event_start is null").count()
    assert lost > 0
    dated, whole = (entry.queries()[n](spark, sf).cache() for n in (name, f"{name}_undated"))
    total = lambda d: d.agg(F.sum("source_record_count")).first()[0]
    assert total(dated) == e.count() - lost and total(whole) == e.count()
    assert whole.count() == dated.count() + lost
    if name != "canonical_events":
        assert dated.exceptAll(whole).count() == 0
