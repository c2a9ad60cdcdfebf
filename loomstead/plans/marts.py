"""Queries of the marts, feature tables and canonical events over the county tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions import clean
from loomstead.functions.eventkeys import fips5, with_identity
from loomstead.operators import marts
from loomstead.operators.catalog import feature_catalog as catalog
from loomstead.operators.events import canonical_declarations, canonical_events as reconcile, collapse_episodes, disaster_events, _standard
from loomstead.plans.panel import r6
from loomstead.plans.tables import table

IDS = ("__source", "__sid", "__county", "__month")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Event records with the county of their identity; the load goes before the code, as loads are never mixed."""
    e = with_identity(table(spark, sf, "extreme_events_county"), IDS)
    return e.withColumn("__county", F.concat_ws("-", "load_id", "__county"))


def _records(spark: SparkSession, sf: str, source: str, undated: bool) -> DataFrame:
    """Event records of a source; without a start only if undated, as the SQL of the queries leaves those out."""
    rows = _events(spark, sf).filter(F.col("__source") == source)
    return rows if undated else rows.filter("event_start is not null")


def _end() -> Column:
    """The end, not before the start; null without a start."""
    return F.when(F.col("event_start").isNotNull(), F.greatest("event_start", "event_end"))


def _declarations(spark: SparkSession, sf: str, undated: bool = False) -> DataFrame:
    kind = F.element_at(F.array(F.lit("DR"), F.lit("EM"), F.lit("FM"), F.lit("OT")), (F.col("record_id") % 4 + 1).cast("int"))
    return _records(spark, sf, "fema", undated).select(
        F.col("record_id").cast("string").alias("id"), F.col("record_id").alias("ord"), F.col("__county").alias("fips"), F.col("__sid").alias("disasterNumber"), kind.alias("declarationType"),
        F.col("event_type").alias("incidentType"), F.col("event_name").alias("declarationTitle"), F.col("event_start").cast("date").alias("incident_begin_date"),
        _end().cast("date").alias("incident_end_date"), F.col("loaded_at").cast("date").alias("lastRefresh"),
    )


def canonical_incidents(spark: SparkSession, sf: str, undated: bool = False) -> DataFrame:
    d = canonical_declarations(_declarations(spark, sf, undated), order="ord")
    day = lambda c: F.col(c).cast("date")
    return d.select("fips", "normalized_event_name", "event_family", day("incident_begin_date").alias("first_day"), day("incident_end_date").alias("last_day"), "id", "source_record_count", "declaration_count", "associated_disaster_numbers", "associated_declaration_types", "canonicalization_reason")


def _storms(spark: SparkSession, sf: str, undated: bool = False) -> DataFrame:
    """Storm records; the month is the episode, a record without a start is one of its own."""
    s = _records(spark, sf, "noaa", undated)
    episode = F.coalesce(F.date_format("event_start", "yyyyMM"), F.concat(F.lit("undated-"), F.col("record_id").cast("string")))
    return s.select(
        F.lit("noaa").alias("event_source"), F.col("__sid").alias("source_event_id"), F.col("__county").alias("fips"), "event_type", "event_name", "event_start", _end().alias("event_end"),
        clean.finite("total_damage_amount").alias("total_damage_amount"), F.lit(1).cast("long").alias("source_record_count"), episode.alias("episode_id"), F.col("record_id").alias("ord"),
    )


def storm_episodes(spark: SparkSession, sf: str, undated: bool = False) -> DataFrame:
    e = collapse_episodes(_standard(_storms(spark, sf, undated), "noaa", "ord"))
    return e.select("fips", "episode_id", "source_event_id", r6("total_damage_amount").alias("damage"), "source_record_count", "associated_source_event_ids")


def canonical_events(spark: SparkSession, sf: str, undated: bool = False) -> DataFrame:
    """Incidents and storm episodes reconciled; damages of the storms count from the first dollar here."""
    d = canonical_declarations(_declarations(spark, sf, undated), order="ord")
    fema = d.select(
        F.lit("fema").alias("event_source"), F.col("disasterNumber").alias("source_event_id"), "fips", F.col("incidentType").alias("event_type"), F.col("declarationTitle").alias("event_name"),
        F.col("incident_begin_date").alias("event_start"), F.col("incident_end_date").alias("event_end"), F.lit(None).cast("double").alias("total_damage_amount"), "source_record_count",
        F.col("associated_disaster_numbers").alias("associated_source_event_ids"), F.col("id").cast("long").alias("ord"),
    )
    out = reconcile(fema, _storms(spark, sf, undated), order="ord")
    return out.select("event_key", "fips", "event_sources", "associated_source_event_keys", "source_event_count", "source_record_count", "semantic_duplicate_count", "canonicalization_reason", "event_start_month", "event_end_month")


def disaster_event_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("has_fema", F.col("event_sources").contains("fema")).withColumn("has_noaa", F.col("event_sources").contains("noaa")).withColumn("total_damage_amount", clean.finite("total_damage_amount"))
    return disaster_events(e).select("record_id", "event_start_month", "event_end_month")


def climate_month_features(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("record_id", F.col("__county").alias("fips"), "event_type", F.to_date("__month").alias("event_start_month"), F.col("event_sources").contains("fema").alias("has_fema"), F.col("event_sources").contains("noaa").alias("has_noaa"), clean.finite("total_damage_amount").alias("total_damage_amount"))
    weather = table(spark, sf, "ref_counties").select("fips", F.to_date(F.lit("2020-01-01")).alias("weather_month"), F.col("population").cast("double").alias("tavg_value"))
    out = marts.climate_features(weather, e)
    return out.select("fips", "climate_month", "fema_event_count", "noaa_extreme_event_count", "extreme_event_count", r6("noaa_extreme_damage_usd").alias("damage"), "has_ncei_weather")


def housing_index(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "county_housing_monthly").withColumn("fips", F.concat_ws("-", "load_id", fips5("fips"))).withColumn("period_begin", F.col("housing_month"))
    metrics = ("median_ppsf_yoy", "avg_sale_to_list_yoy", "homes_sold_yoy", "inventory_yoy")
    out = marts.housing_features(h.withColumns({m: clean.finite(m) for m in metrics}), metrics)
    return out.select("fips", "housing_month", *[r6(m).alias(m) for m in metrics], r6("housing_market_index").alias("housing_market_index"))


def demographic_features(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "county_demographic_annual").withColumn("fips", F.concat_ws("-", "load_id", fips5("fips")))
    demo = d.select("fips", "year", *[clean.finite(c).cast("string").alias(c) for c in ("total_population", "age_65_plus_pct", "disability_pct")], (100 - clean.finite("no_broadband_pct")).cast("string").alias("broadband_pct"))
    moved = d.filter("has_statsamerica_migration").select("fips", "year", clean.finite("total_net_migration").alias("total_net_migration"))
    out = marts.demographic_features(demo, moved)
    return out.select("fips", "year", r6("total_population").alias("total_population"), r6("disability_pct").alias("disability_pct"), r6("total_net_migration").alias("total_net_migration"), r6("net_migration_rate_pct").alias("net_migration_rate_pct"), "has_acs_demographic", "has_statsamerica_migration")


def feature_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark)


QUERIES = {f.__name__: f for f in (canonical_incidents, storm_episodes, canonical_events, disaster_event_filter, climate_month_features, housing_index, demographic_features, feature_catalog)}
#: The whole job, with the records that have no start.
QUERIES |= {f"{f.__name__}_undated": partial(f, undated=True) for f in (canonical_incidents, storm_episodes, canonical_events)}

_ID = """i AS (SELECT *, CASE WHEN event_key IS NOT NULL THEN lower(trim(split_part(event_key, ':', 1))) ELSE event_source END AS src, CASE WHEN event_key IS NOT NULL THEN trim(split_part(event_key, ':', 2)) ELSE source_event_id END AS sid,
  CASE WHEN event_key IS NOT NULL THEN load_id || '-' || lpad(trim(split_part(event_key, ':', 3)), 5, '0') ELSE load_id || '-' || lpad(trim(fips), 5, '0') END AS county,
  CASE WHEN event_key IS NOT NULL THEN CAST(substr(trim(split_part(event_key, ':', 4)), 1, 10) AS DATE) ELSE event_start_month END AS mon FROM extreme_events_county)"""
_LABEL = "coalesce(trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g')), '')"
_DAMAGE = "CASE WHEN isnan(total_damage_amount) THEN NULL ELSE total_damage_amount END"
_EXCLUDED = "('Biological', 'Dam/Levee Break', 'Chemical', 'Terrorist', 'Other', 'Toxic Substances')"


def _family() -> str:
    from loomstead.functions.text import FAMILIES

    return "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{f}'" for f, p in FAMILIES) + " ELSE coalesce(nullif(t, ''), 'other') END"


_SEN = "CASE WHEN isnan({0}) OR {0} <= -888888000 THEN NULL ELSE {0} END"
_M4 = ("median_ppsf_yoy", "avg_sale_to_list_yoy", "homes_sold_yoy", "inventory_yoy")
SQL = {
    "canonical_incidents": f"""WITH {_ID}, d AS (SELECT CAST(record_id AS VARCHAR) AS id, record_id AS ord, county AS fips, sid AS num, CASE record_id % 4 WHEN 0 THEN 'DR' WHEN 1 THEN 'EM' WHEN 2 THEN 'FM' ELSE 'OT' END AS typ, record_id % 4 AS pr,
  {_LABEL.format('event_type')} AS t, {_LABEL.format('event_type')} || ' ' || {_LABEL.format('event_name')} AS x, coalesce(nullif({_LABEL.format('event_name')}, ''), 'DISASTER ' || sid) AS name,
  CAST(event_start AS DATE) AS b, CAST(coalesce(greatest(event_start, event_end), event_start) AS DATE) AS e, CAST(loaded_at AS DATE) AS rf FROM i WHERE src = 'fema' AND event_start IS NOT NULL),
r AS (SELECT *, max(e) OVER (PARTITION BY fips, name ORDER BY b, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach + 7 THEN 1 ELSE 0 END) OVER (PARTITION BY fips, name ORDER BY b, e, ord ROWS UNBOUNDED PRECEDING) AS c FROM r),
a AS (SELECT fips, name, c, min(b) AS b, max(e) AS e, count(*) AS n, count(DISTINCT num) AS dn, array_to_string(list_sort(list_distinct(list(CAST(num AS BIGINT)))), '|') AS nums, string_agg(DISTINCT typ, '|' ORDER BY typ) AS typs FROM k GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY fips, name, c ORDER BY CASE WHEN pr = 3 THEN 9 ELSE pr END, rf DESC NULLS LAST, CAST(num AS DOUBLE), ord) AS rn FROM k)
SELECT f.fips, f.name AS normalized_event_name, {_family()} AS event_family, a.b AS first_day, a.e AS last_day, id, a.n AS source_record_count, a.dn AS declaration_count, a.nums AS associated_disaster_numbers, a.typs AS associated_declaration_types,
  CASE WHEN a.n > 1 THEN 'fema_semantic_duplicate' ELSE 'single_source_record' END AS canonicalization_reason FROM f JOIN a ON a.fips = f.fips AND a.name = f.name AND a.c = f.c WHERE rn = 1""",
    "storm_episodes": f"""WITH {_ID}, s AS (SELECT county AS fips, sid, strftime(event_start, '%Y%m') AS ep, {_DAMAGE} AS dmg, record_id FROM i WHERE src = 'noaa' AND event_start IS NOT NULL),
a AS (SELECT fips, ep, max(dmg) AS dmg, count(*) AS n, array_to_string(list_sort(list_distinct(list(CAST(sid AS BIGINT)))), '|') AS ids FROM s GROUP BY 1, 2), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fips, ep ORDER BY coalesce(dmg, -1) DESC, record_id) = 1)
SELECT a.fips, a.ep AS episode_id, f.sid AS source_event_id, round(a.dmg, 6) AS damage, a.n AS source_record_count, a.ids AS associated_source_event_ids FROM a JOIN f ON a.fips = f.fips AND a.ep = f.ep""",
    "disaster_event_filter": f"""WITH {_ID}, e AS (SELECT *, coalesce(event_end, event_start) AS en FROM i WHERE (contains(event_sources, 'fema') AND event_type NOT IN {_EXCLUDED}) OR (contains(event_sources, 'noaa') AND {_DAMAGE} >= 1e9))
SELECT record_id, CAST(date_trunc('month', event_start) AS DATE) AS event_start_month, CAST(date_trunc('month', en) AS DATE) AS event_end_month FROM e WHERE en >= event_start""",
    "climate_month_features": f"""WITH {_ID}, e AS (SELECT county AS fips, mon AS climate_month, coalesce(contains(event_sources, 'fema') AND event_type NOT IN {_EXCLUDED}, FALSE) AS f, coalesce(contains(event_sources, 'noaa') AND {_DAMAGE} >= 1e9, FALSE) AS n, {_DAMAGE} AS dmg FROM i),
g AS (SELECT fips, climate_month, count(*) FILTER (f) AS fc, count(*) FILTER (n) AS nc, count(*) FILTER (f OR n) AS ec, coalesce(sum(dmg) FILTER (n), 0) AS dmg FROM e WHERE fips IS NOT NULL AND climate_month IS NOT NULL GROUP BY 1, 2),
w AS (SELECT fips, DATE '2020-01-01' AS climate_month FROM ref_counties), k AS (SELECT fips, climate_month FROM g UNION SELECT fips, climate_month FROM w)
SELECT k.fips, k.climate_month, coalesce(fc, 0) AS fema_event_count, coalesce(nc, 0) AS noaa_extreme_event_count, coalesce(ec, 0) AS extreme_event_count, round(coalesce(dmg, 0), 6) AS damage, w.fips IS NOT NULL AS has_ncei_weather FROM k LEFT JOIN g USING (fips, climate_month) LEFT JOIN w USING (fips, climate_month)""",
    "housing_index": "WITH m AS (SELECT load_id || '-' || lpad(trim(fips), 5, '0') AS fips, housing_month, " + ", ".join(f"max(CASE WHEN isnan({c}) THEN NULL ELSE {c} END) AS {c}" for c in _M4) + " FROM county_housing_monthly GROUP BY 1, 2), n AS (SELECT fips, housing_month, " + ", ".join(f"{_SEN.format(c)} AS {c}" for c in _M4)
    + " FROM m), s AS (SELECT " + ", ".join(f"avg({c}) AS a{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(_M4)) + " FROM n), z AS (SELECT n.*, " + ", ".join(f"{'-' if c == 'inventory_yoy' else ''}({c} - a{i}) / nullif(s{i}, 0) AS z{i}" for i, c in enumerate(_M4))
    + " FROM n, s) SELECT fips, housing_month, " + ", ".join(f"round({c}, 6) AS {c}" for c in _M4) + ", round((coalesce(z0, 0) + coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0)) / nullif((z0 IS NOT NULL)::INT + (z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT, 0), 6) AS housing_market_index FROM z",
    "demographic_features": """WITH d AS (SELECT *, load_id || '-' || lpad(trim(fips), 5, '0') AS f FROM county_demographic_annual), a AS (SELECT f, year, max(CASE WHEN isnan(total_population) THEN NULL ELSE total_population END) AS tp, max(CASE WHEN isnan(disability_pct) THEN NULL ELSE disability_pct END) AS dp FROM d GROUP BY 1, 2),
m AS (SELECT f, year, max(CASE WHEN isnan(total_net_migration) THEN NULL ELSE total_net_migration END) AS tm FROM d WHERE has_statsamerica_migration GROUP BY 1, 2)
SELECT a.f AS fips, a.year, round(tp, 6) AS total_population, round(dp, 6) AS disability_pct, round(tm, 6) AS total_net_migration, round(tm / nullif(tp, 0) * 100.0, 6) AS net_migration_rate_pct, TRUE AS has_acs_demographic, m.f IS NOT NULL AS has_statsamerica_migration FROM a LEFT JOIN m USING (f, year) WHERE a.f IS NOT NULL AND a.year IS NOT NULL""",
}
