"""Canonical incidents from declarations and storm records, and the events that qualify for analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.clean import code5
from loomstead.functions.text import event_family, event_name
from loomstead.operators.relational import first_per_key, islands, joined_unique
from loomstead.session import cut_lineage

CLUSTER_DAYS = 7
MATCH_DAYS = 3
DAMAGE_THRESHOLD = 1e9
#: Incident types that are not weather or geology.
EXCLUDED_TYPES = ("Biological", "Dam/Levee Break", "Chemical", "Terrorist", "Other", "Toxic Substances")
DECLARATION_COLUMNS = ("fips", "disasterNumber", "declarationType", "incidentType", "declarationTitle", "incident_begin_date", "incident_end_date")
#: Days of a time bucket in which declarations and storms meet.
BUCKET_DAYS = 32
STANDARD = ("event_source", "source_event_id", "fips", "event_type", "event_name", "event_start", "event_end", "total_damage_amount")


def _need(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _in_order(df: DataFrame, order: str | None) -> DataFrame:
    """df with __order, the given column or a number that is written once, so that every branch and every retry sees the same."""
    if order:
        return df.withColumn("__order", F.col(order).cast("long"))
    return cut_lineage(df.withColumn("__order", F.monotonically_increasing_id()))


def canonical_declarations(df: DataFrame, tolerance_days: int = CLUSTER_DAYS, order: str | None = None) -> DataFrame:
    """One row per county incident.

    Declarations of a county under the same name whose periods overlap or lie at most tolerance_days
    apart are one incident, represented by the best declaration (type DR, EM, FM, others; newest
    refresh; lowest number; input order), with the earliest begin and the latest end. A null end is the
    begin; an unreadable begin stands alone; an empty title is named after its number. Groups are one
    county and name, so no task sees more than the declarations of one name in one county.
    """
    _need(df, DECLARATION_COLUMNS)
    has = set(df.columns)
    src = _in_order(df, order)
    begin = F.col("incident_begin_date").cast("string").try_cast("timestamp_ntz")
    end = F.coalesce(F.col("incident_end_date").cast("string").try_cast("timestamp_ntz"), begin)
    number = F.col("disasterNumber").try_cast("double")
    name = F.coalesce(F.nullif(event_name(F.col("declarationTitle")), F.lit("")), F.concat(F.lit("DISASTER "), F.col("disasterNumber").cast("string")))
    src = src.withColumns({
        "incident_begin_date": begin, "incident_end_date": end, "normalized_event_name": name,
        "event_family": event_family(F.col("incidentType"), F.col("declarationTitle")),
        "__priority": F.when(F.col("declarationType") == "DR", 0).when(F.col("declarationType") == "EM", 1).when(F.col("declarationType") == "FM", 2).otherwise(9),
        "__refresh": F.col("lastRefresh").cast("string").try_cast("timestamp_ntz") if "lastRefresh" in has else F.lit(None).cast("timestamp_ntz"),
        "__record": F.col("id").cast("string") if "id" in has else F.col("__order").cast("string"), "__number": number,
    })
    keys = ["fips", "normalized_event_name", "__cluster"]
    clustered = islands(src, keys[:2], "incident_begin_date", "incident_end_date", tolerance_days, ["__order"], "__cluster")
    facts = clustered.groupBy(*keys).agg(
        F.min("incident_begin_date").alias("__b"), F.max("incident_end_date").alias("__e"), F.count(F.lit(1)).alias("source_record_count"),
        F.countDistinct("disasterNumber").alias("declaration_count"), joined_unique("disasterNumber", numeric=True).alias("associated_disaster_numbers"),
        joined_unique("declarationType").alias("associated_declaration_types"), joined_unique("__record").alias("associated_source_record_ids"),
    )
    best = first_per_key(clustered, keys, [F.col("__priority").asc(), F.col("__refresh").desc_nulls_last(), F.col("__number").asc_nulls_last(), F.col("__order").asc()])
    same = [best[k].eqNullSafe(facts[k]) for k in keys]
    out = best.join(facts, same).drop(*[facts[k] for k in keys])
    return (
        out.withColumns({
            "incident_begin_date": F.col("__b"), "incident_end_date": F.col("__e"),
            "canonicalization_reason": F.when(F.col("source_record_count") > 1, "fema_semantic_duplicate").otherwise("single_source_record"),
        }).drop("__order", "__priority", "__refresh", "__record", "__number", "__cluster", "__b", "__e")
    )


def _standard(df: DataFrame, source: str, order: str | None) -> DataFrame:
    _need(df, STANDARD)
    df = _in_order(df, order)
    has = set(df.columns)
    one = F.lit(1).cast("long")
    return df.select(
        F.lit(source).alias("event_source"), F.col("source_event_id").cast("string").alias("source_event_id"), code5("fips").alias("fips"), "event_type", "event_name",
        F.col("event_start").cast("timestamp_ntz").alias("event_start"), F.coalesce(F.col("event_end"), F.col("event_start")).cast("timestamp_ntz").alias("event_end"),
        F.col("total_damage_amount").cast("double").alias("total_damage_amount"),
        (F.coalesce(F.col("source_record_count").cast("long"), one) if "source_record_count" in has else one).alias("source_record_count"),
        (F.coalesce(F.col("associated_source_event_ids"), F.col("source_event_id").cast("string")) if "associated_source_event_ids" in has else F.col("source_event_id").cast("string")).alias("associated_source_event_ids"),
        (F.nullif(F.trim(F.col("episode_id").cast("string")), F.lit("")) if "episode_id" in has else F.lit(None).cast("string")).alias("episode_id"),
        event_name(F.col("event_name")).alias("normalized_event_name"), event_family(F.col("event_type"), F.col("event_name")).alias("event_family"),
        "__order",
    )


def collapse_episodes(storms: DataFrame) -> DataFrame:
    """One row per county and episode: the most damaging record (null damage last, then input order), with counts and ids of all."""
    key = F.coalesce("episode_id", F.concat_ws("|", F.col("normalized_event_name"), F.col("event_start").cast("string"), F.col("event_end").cast("string")))
    storms = storms.withColumn("__episode", key)
    facts = storms.groupBy("fips", "__episode").agg(
        F.max("total_damage_amount").alias("__damage"), F.sum("source_record_count").alias("__records"), joined_unique("source_event_id", numeric=True).alias("__ids"), F.min("event_start").alias("__s"), F.max("event_end").alias("__e")
    )
    best = first_per_key(storms, ["fips", "__episode"], [F.coalesce("total_damage_amount", F.lit(-1.0)).desc(), F.col("__order").asc()])
    return best.alias("b").join(facts.alias("f"), [F.col("b.fips").eqNullSafe(F.col("f.fips")), F.col("b.__episode") == F.col("f.__episode")]).select(
        "b.*", "f.__damage", "f.__records", "f.__ids"
    ).withColumns({"total_damage_amount": F.col("__damage"), "source_record_count": F.col("__records"), "associated_source_event_ids": F.col("__ids")}).drop("__damage", "__records", "__ids", "__episode")


def canonical_events(declarations: DataFrame, storms: DataFrame, tolerance_days: int = MATCH_DAYS, order: str | None = None) -> DataFrame:
    """Declarations and storm episodes as one table of incidents.

    A storm episode joins the declaration of its county and family whose period, widened by
    tolerance_days, it meets; of several the one closest in start plus end, then the earlier, then the
    first. Damages are maximised, not added. A matched episode contributes its representative id only,
    one that stays alone all of its ids.
    """
    decl, noaa = _standard(declarations, "fema", order), collapse_episodes(_standard(storms, "noaa", order))
    # both sides meet within time buckets, so a county with many records is not met as a whole; a pair counts where the later one begins
    widen = F.make_dt_interval(F.lit(tolerance_days))
    bucket = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / BUCKET_DAYS).cast("int")

    def reach(d: DataFrame, by: Column) -> DataFrame:
        ends = (F.col("event_start") - by, F.col("event_end") + by)
        d = d.withColumns({"__lo": F.least(*ends), "__hi": F.greatest(*ends)}).filter("event_start is not null and event_end is not null")
        return d.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__lo")), bucket(F.col("__hi")))))

    a, b = reach(decl, widen).alias("a"), reach(noaa, F.make_dt_interval()).alias("b")
    near = (F.col("a.__bucket") == F.col("b.__bucket")) & (F.col("a.__bucket") == bucket(F.greatest("a.__lo", "b.__lo"))) & (F.col("a.fips") == F.col("b.fips")) & (F.col("a.event_family") == F.col("b.event_family")) & (F.col("a.event_start") <= F.col("b.event_end") + widen) & (F.col("a.event_end") >= F.col("b.event_start") - widen)
    gap = F.abs(F.datediff("a.event_start", "b.event_start")) + F.abs(F.datediff("a.event_end", "b.event_end"))
    hits = b.join(a, near).select(
        F.col("b.__order").alias("storm"), F.col("a.__order").alias("decl"), gap.alias("gap"), F.col("a.event_start").alias("s"),
        F.col("b.source_event_id").alias("sid"), F.col("b.total_damage_amount").alias("dmg"), F.col("b.source_record_count").alias("cnt"),
    )
    hits = first_per_key(hits, ["storm"], [F.col("gap"), F.col("s"), F.col("decl")])
    merged = hits.groupBy("decl").agg(F.array_sort(F.collect_list(F.struct("storm", "sid"))).alias("m"), F.max("dmg").alias("m_damage"), F.sum("cnt").alias("m_records"))
    fema_keys = F.transform(F.split("associated_source_event_ids", r"\|"), lambda x: F.concat(F.lit("fema:"), x))
    noaa_keys = F.transform(F.coalesce("m", F.array().cast("array<struct<storm:bigint,sid:string>>")), lambda x: F.concat(F.lit("noaa:"), x["sid"]))
    with_storms = decl.join(merged, decl["__order"] == merged["decl"], "left").withColumn("__keys", F.array_distinct(F.concat(fema_keys, noaa_keys))).withColumns({
        "has_fema": F.lit(True), "has_noaa": F.col("m").isNotNull(),
        "total_damage_amount": F.coalesce("m_damage", "total_damage_amount"),
        "source_record_count": F.col("source_record_count") + F.coalesce("m_records", F.lit(0)),
        "canonicalization_reason": F.when(F.col("m").isNotNull(), "cross_source_match").when(F.size("__keys") > 1, "fema_semantic_duplicate").otherwise("single_source_record"),
    }).drop("m", "m_damage", "m_records", "decl")
    alone = noaa.join(hits.select(F.col("storm").alias("__order")), "__order", "left_anti")
    alone = alone.withColumn("__keys", F.transform(F.split("associated_source_event_ids", r"\|"), lambda x: F.concat(F.lit("noaa:"), x))).withColumns({
        "has_fema": F.lit(False), "has_noaa": F.lit(True), "canonicalization_reason": F.when(F.size("__keys") > 1, "noaa_episode_duplicate").otherwise("single_source_record"),
    })
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    out = with_storms.unionByName(alone.select(*with_storms.columns))
    out = out.withColumns({
        "event_start_month": month("event_start"), "event_end_month": month("event_end"),
        "event_sources": F.concat_ws("|", F.when(F.col("has_fema"), "fema"), F.when(F.col("has_noaa"), "noaa")),
        "associated_source_event_keys": F.array_join("__keys", "|"), "source_event_count": F.size("__keys").cast("long"),
        "semantic_duplicate_count": (F.size("__keys") - 1).cast("long"),
    })
    key = F.concat_ws(":", "event_source", "source_event_id", "fips", F.date_format("event_start_month", "yyyy-MM-dd"))
    return out.withColumn("event_key", key).drop("__keys", "__order", "episode_id", "associated_source_event_ids")


def qualifies(fema: bool = True, noaa: bool = True, excluded: Sequence[str] = EXCLUDED_TYPES, least_damage: float = DAMAGE_THRESHOLD) -> Column:
    """A declared event of a kept type, or a storm of great damage; a null type is no kept type, a null damage not great."""
    out = F.lit(False)
    if fema:
        out = out | (F.col("has_fema") & ~F.col("event_type").isin(*excluded))
    if noaa:
        out = out | (F.col("has_noaa") & (F.col("total_damage_amount") >= least_damage))
    return F.coalesce(out, F.lit(False))


def disaster_events(events: DataFrame, fema: bool = True, noaa: bool = True) -> DataFrame:
    """Qualifying events with a start, an end (by default the start) not before it, and both months."""
    end = F.coalesce("event_end", "event_start")
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    return events.filter(qualifies(fema, noaa)).withColumn("event_end", end).filter(F.col("event_end") >= F.col("event_start")).withColumns(
        {"event_start_month": month("event_start"), "event_end_month": month("event_end")}
    )


def overlapping_pairs(df: DataFrame, entity: Sequence[str], key: str, start: str, end: str, bucket_days: int = 32) -> DataFrame:
    """(entity, key_a, key_b) of intervals of an entity that share an instant, key_a below key_b.

    Intervals meet within time buckets, so work follows the overlaps, not the square of an entity's rows;
    a pair counts in the bucket of its later start only.
    """
    number = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days).cast("int")
    rows = df.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(*entity, F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    rows = rows.withColumn("__bucket", F.explode(F.sequence(number(F.col("__s")), number(F.col("__e")))))
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in [*entity, "__bucket"]]
    met = a.join(b, [*same, F.col("a.__k") < F.col("b.__k"), F.col("a.__s") <= F.col("b.__e"), F.col("b.__s") <= F.col("a.__e")])
    met = met.filter(F.col("a.__bucket") == number(F.greatest("a.__s", "b.__s")))
    return met.select(*[F.col(f"a.{x}").alias(x) for x in entity], F.col("a.__k").alias("key_a"), F.col("b.__k").alias("key_b"))


def latest_complete_year(panel: DataFrame, month: str, years: int = 10) -> DataFrame:
    """(window_start, window_end) of the years that end with the latest one of twelve months; ValueError belongs to the caller if empty."""
    full = panel.groupBy(F.year(month).alias("y")).agg(F.countDistinct(F.month(month)).alias("m")).filter("m = 12").agg(F.max("y").alias("y")).filter("y is not null")
    return full.select(F.make_date(F.col("y") - (years - 1), F.lit(1), F.lit(1)).alias("window_start"), F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("window_end"))
