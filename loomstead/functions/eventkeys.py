"""Identity of event records, however their keys are spelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What counts as a blank.
BLANKS = " \t\n\x0b\f\r"
PARTS = ("source", "source_id", "county", "month")


def _bare(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _digits(c: Column) -> Column:
    return F.length(c).between(1, 5) & (F.translate(c, "0123456789", "") == "")


def fips5(col: Column | str) -> Column:
    """County code of five digits: blanks removed, lost leading zeros put back; null if nothing but digits does not remain."""
    c = F.translate(F.col(col) if isinstance(col, str) else col, BLANKS, "")
    return F.when(_digits(c), F.lpad(c, 5, "0"))


def _parts(source: Column, source_id: Column, county: Column, month: Column) -> Column:
    """Struct of the cleaned parts; null if one of them is missing or unreadable."""
    source, source_id, county, month = (_bare(c) for c in (source, source_id, county, month))
    day = F.substring(month, 1, 10)
    fine = (source != "") & (source_id != "") & _digits(county) & day.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(fine, F.struct(F.lower(source).alias("source"), F.lower(source_id).alias("source_id"), F.lpad(county, 5, "0").alias("county"), day.alias("month")))


def _cut(key: str) -> Column:
    # one plain character cuts without a pattern
    cut = F.split(F.col(key), ":", 4)
    return _parts(*[F.get(cut, F.lit(i)) for i in range(4)])


def _named(df: DataFrame, found: Column, names: tuple[str, str, str, str]) -> DataFrame:
    return df.withColumn("__cut", found).withColumns({n: F.col("__cut")[p] for n, p in zip(names, PARTS)}).drop("__cut")


def with_key_parts(df: DataFrame, key: str, names: tuple[str, str, str, str] = PARTS) -> DataFrame:
    """Add source, source id, county and month of an event key; all null if the key is null or unreadable.

    Letter case, blanks around the parts, lost leading zeros of the county and a time of day after the
    month make no difference.
    """
    return _named(df, _cut(key), names)


def with_identity(df: DataFrame, names: tuple[str, str, str, str] = PARTS) -> DataFrame:
    """Add the identity of event records: that of event_key, or where it is null or unreadable that of the columns it is made of.

    A record whose identity lacks a part has none (all parts null) and is in no group.
    """
    made = _parts(F.col("event_source"), F.col("source_event_id"), F.col("fips"), F.col("event_start_month").cast("string"))
    return _named(df, F.coalesce(_cut("event_key"), made), names)


def source_keys(col: Column | str) -> Column:
    """Array of distinct keys source:id of a list spelled with any of | ; , and blanks; empty for null."""
    c = F.col(col) if isinstance(col, str) else col
    items = F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), "|;" + BLANKS, ",,"), ",")
    whole = lambda p: (F.length(p) - F.length(F.translate(p, ":", "")) == 1) & ~p.startswith(":") & ~p.endswith(":")
    return F.array_distinct(F.filter(items, whole))
