"""Queries of the table-hygiene operators over the county panels, event records, drifting files and raw lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.eventkeys import fips5, with_identity
from loomstead.operators.imputation import propagate_categories, propagate_numbers
from loomstead.operators.intervals import continuous_periods, interval_gaps
from loomstead.operators.profile import ColumnRule, profile_loads, unusual_loads
from loomstead.plans.tables import table
from loomstead.sources.drift import number_text, schema_changes, series_table
from loomstead.sources.rejects import INCOME_LINES, load_strict, reject_reasons

FILL_COLUMNS = ("median_ppsf_usd", "homes_sold_yoy")
#: Standardised difference of means from which on a load counts as shifted.
SHIFT = 0.5
CATEGORY_COLUMNS = ("county_name", "state_code")
FILL_HUBS = (("load_id", "__county"), ("load_id", "__state", "housing_month"))
PANEL_RULES = (
    ColumnRule("county_housing_monthly", "median_sale_price_usd", 1_000, 10_000_000),
    ColumnRule("county_economic_annual", "dp03_median_household_income_usd", 5_000, 400_000),
    ColumnRule("county_demographic_annual", "disability_pct", 0, 100),
)


def _housing(spark: SparkSession, sf_dir: str) -> DataFrame:
    county = fips5("fips")
    return table(spark, sf_dir, "county_housing_monthly").withColumn("__county", county).withColumn("__state", F.substring(county, 1, 2))


def _housing_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagate_numbers(_housing(spark, sf_dir), "row_id", FILL_COLUMNS, FILL_HUBS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _housing_fills(spark, sf_dir).filter("hops = 1").select("row_id", "column_name")


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing cell with its estimate, the mark and the round it was reached in."""
    return _housing_fills(spark, sf_dir)


def p2_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing cell of the categorical columns with its estimate, its share, the mark and the round it was reached in."""
    housing = _housing(spark, sf_dir)
    parts = []
    for c in CATEGORY_COLUMNS:
        missing = housing.filter(F.coalesce(F.trim(c), F.lit("")) == "").select("row_id")
        fills = propagate_categories(housing, "row_id", c, FILL_HUBS, 3)
        parts.append(missing.join(fills, "row_id", "left").select("row_id", F.lit(c).alias("column_name"), "value", "share", F.col("value").isNotNull().alias("filled"), "hops"))
    return reduce(DataFrame.unionByName, parts)


def _county_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_identity(table(spark, sf_dir, "extreme_events_county"), ("__source", "__id", "__county", "__month"))
    return events.select("load_id", F.col("__county").alias("fips"), "event_start", "event_end")


def _stamp(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = interval_gaps(_county_events(spark, sf_dir), ["load_id", "fips"], "event_start", "event_end")
    return gaps.select("load_id", "fips", _stamp("gap_start").alias("gap_start"), _stamp("gap_end").alias("gap_end"))


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = continuous_periods(_county_events(spark, sf_dir), ["load_id", "fips"], "event_start", "event_end")
    return periods.select("load_id", "fips", _stamp("period_start").alias("period_start"), _stamp("period_end").alias("period_end"))


def _panel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {r.table: table(spark, sf_dir, r.table) for r in PANEL_RULES}
    return profile_loads(tables, PANEL_RULES)


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each load, the exact power sums as text, what is divided or drawn from them to six decimals."""
    profile = _panel_profile(spark, sf_dir)
    derived = ("mean", "stddev", "skewness", "standardised_difference")
    sums = [c for c, t in profile.dtypes if t == "decimal(38,0)"]
    return profile.select(*[F.col(c).cast("string").alias(c) if c in sums else F.round(c, 6).alias(c) if c in derived else F.col(c) for c in profile.columns])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that stand out by any flag; those that do by a shift of the mean alone are no cases by definition and are dropped last."""
    return unusual_loads(_panel_profile(spark, sf_dir), shift_above=SHIFT).filter("why != 'shift'").select("table_name", "column_name", "load_id")


def _drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "census_acs5_county_dp02_test")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = schema_changes(_drifting(spark, sf_dir), "series_id", "file_seq", "file_id", "payload")
    return changes.select("file_id", "field_name", "change_kind")


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all files; shares, margins and rates of dp02 are numbers, what has no type of its own is text."""
    code = lambda width: lambda c: F.lpad(F.trim(c), width, "0")
    text = lambda c: c
    wanted = {
        "year": lambda c: F.trim(c).try_cast("int"),
        "state": code(2),
        "county": code(3),
        **{f"dp02_{n}_pct": number_text for n in ("0066", "0067", "0072", "0092")},
        "dp02_0066_moe": number_text,
        "domestic_in_migration_rate": number_text,
        "source_note": text,
    }
    return series_table(
        _drifting(spark, sf_dir), ["series_id", "file_id", "file_seq", "row_no"], "series_id", "file_seq", "file_id", "payload",
        wanted, lambda c: number_text if re.fullmatch(r"dp02_\d{4}_(pct|moe)", c) else text,
    )


def _income_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "statsamerica_bea_personal_income").filter(~F.col("line_no").eqNullSafe(F.lit(1)))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_reasons(_income_lines(spark, sf_dir), ["line_id"], "line", INCOME_LINES).select("line_id", "reason")


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_strict(_income_lines(spark, sf_dir), "line", INCOME_LINES)
    return rows.select(
        "line_id", fips5(F.trim("IBRC_GEO_ID")).alias("fips"), F.col("Description").alias("description"),
        F.trim("Year").cast("int").alias("year"), F.trim("Linecode").alias("linecode"),
        F.when(F.trim("Disclosure") == "0", F.trim("Data").try_cast("double")).alias("data"),
        F.trim("Disclosure").alias("disclosure"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_filled, p2_categories, p3_found, p3_periods, p5_found, p5_profile, p6_found, p6_table, p7_found, p7_loaded)}

_IDENTITY = """
  SELECT *, CASE WHEN event_key IS NOT NULL THEN lpad(trim(split_part(event_key, ':', 3)), 5, '0') ELSE lpad(trim(fips), 5, '0') END AS county
  FROM extreme_events_county"""

_PANEL = """
WITH v AS (
  SELECT 'county_housing_monthly' AS table_name, 'median_sale_price_usd' AS column_name, load_id,
         CASE WHEN isnan(median_sale_price_usd) THEN NULL ELSE CAST(median_sale_price_usd AS VARCHAR) END AS stored, 1000.0 AS low, 10000000.0 AS high FROM county_housing_monthly
  UNION ALL
  SELECT 'county_economic_annual', 'dp03_median_household_income_usd', load_id,
         CASE WHEN trim(dp03_median_household_income_usd) = '' THEN NULL ELSE dp03_median_household_income_usd END, 5000.0, 400000.0 FROM county_economic_annual
  UNION ALL
  SELECT 'county_demographic_annual', 'disability_pct', load_id,
         CASE WHEN isnan(disability_pct) THEN NULL ELSE CAST(disability_pct AS VARCHAR) END, 0.0, 100.0 FROM county_demographic_annual
), n AS (
  SELECT *, CASE WHEN table_name = 'county_economic_annual' AND NOT regexp_matches(trim(stored), '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)([.][0-9]+)?$') THEN NULL
                 ELSE TRY_CAST(replace(trim(stored), ',', '') AS DOUBLE) END AS x FROM v
), g AS (SELECT *, CASE WHEN x BETWEEN low AND high THEN x END AS good FROM n)
, p AS (
  SELECT table_name, column_name, load_id, count(*) AS n_rows,
         count(*) - count(stored) AS missing, count(stored) - count(good) AS bad, count(good) AS n_good,
         count(DISTINCT stored) AS distinct_values, median(good) AS med
  FROM g GROUP BY 1, 2, 3
)"""

#: The spellings of each field, for the SQL alone; the operator finds them from names and values.
_SPELLINGS = {
    "year": ("year", "Year", "YEAR", "acs_year", "survey_year"),
    "state": ("state", "STATE", "state_fips", "statefp"),
    "county": ("county", "COUNTY", "county_fips", "countyfp"),
    "dp02_0066_pct": ("dp02_0066_pct", "dp02_0066_percent", "dp02-0066-pct", "dp02_0066pe", "DP02_0066PE"),
    "dp02_0067_pct": ("dp02_0067_pct", "dp02_0067_percent", "Dp02_0067_Pct", "DP02_0067PE"),
    "dp02_0072_pct": ("dp02_0072_pct", "dp02_0072pe", "DP02_0072PE"),
    "dp02_0092_pct": ("dp02_0092_pct", "dp02_0092_percent", "DP02_0092PE"),
    "dp02_0066_moe": ("dp02_0066_moe", "dp02_0066_margin", "DP02_0066PM"),
    "domestic_in_migration_rate": ("domestic_in_migration_rate", "domestic_inmigration_rate", "DOMESTIC_IN_MIGRATION_RATE"),
    "source_note": ("source_note", "src_note", "SOURCE_NOTE"),
}


def _table_sql() -> str:
    held = {c: "coalesce(" + ", ".join(f"json_extract_string(j, '$.\"{n}\"')" for n in names) + ")" for c, names in _SPELLINGS.items()}
    number = lambda c: f"TRY_CAST(regexp_replace({c}, '^\\s+|\\s*%?\\s*$', '', 'g') AS DOUBLE)"
    typed = {
        "year": f"TRY_CAST(trim({held['year']}) AS INT)", "state": f"lpad(trim({held['state']}), 2, '0')", "county": f"lpad(trim({held['county']}), 3, '0')",
        **{c: number(held[c]) for c in held if c.startswith("dp02") or c.endswith("rate")}, "source_note": held["source_note"],
    }
    columns = ", ".join(f"{x} AS {c}" for c, x in typed.items())
    return f"WITH p AS (SELECT *, TRY_CAST(payload AS JSON) AS j FROM census_acs5_county_dp02_test) SELECT series_id, file_id, file_seq, row_no, {columns} FROM p"


SQL = {
    "p6_table": _table_sql(),
    "p2_found": """
WITH b AS (
  SELECT row_id, load_id, lpad(trim(fips), 5, '0') AS county, housing_month, 'median_ppsf_usd' AS column_name, median_ppsf_usd AS v FROM county_housing_monthly
  UNION ALL
  SELECT row_id, load_id, lpad(trim(fips), 5, '0'), housing_month, 'homes_sold_yoy', homes_sold_yoy FROM county_housing_monthly
), c AS (SELECT *, v IS NULL OR isnan(v) OR v <= -100000000 AS missing FROM b),
h AS (SELECT DISTINCT load_id, column_name, county FROM c WHERE NOT missing),
s AS (SELECT DISTINCT load_id, column_name, substr(county, 1, 2) AS st, housing_month FROM c WHERE NOT missing)
SELECT row_id, column_name FROM c
WHERE missing AND (EXISTS (SELECT 1 FROM h WHERE h.load_id = c.load_id AND h.column_name = c.column_name AND h.county = c.county)
  OR EXISTS (SELECT 1 FROM s WHERE s.load_id = c.load_id AND s.column_name = c.column_name AND s.st = substr(c.county, 1, 2) AND s.housing_month = c.housing_month))""",
    "p3_found": f"""
WITH i AS ({_IDENTITY}), r AS (
  SELECT load_id, county AS fips, event_start AS s, coalesce(event_end, event_start) AS e FROM i
  WHERE event_start IS NOT NULL AND coalesce(event_end, event_start) >= event_start
), m AS (SELECT *, max(e) OVER (PARTITION BY load_id, fips ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r)
SELECT load_id, fips, strftime(reach, '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(s, '%Y-%m-%d %H:%M:%S') AS gap_end FROM m WHERE reach < s""",
    "p3_periods": f"""
WITH i AS ({_IDENTITY}), r AS (
  SELECT load_id, county AS fips, event_start AS s, coalesce(event_end, event_start) AS e FROM i
  WHERE event_start IS NOT NULL AND coalesce(event_end, event_start) >= event_start
), m AS (SELECT *, max(e) OVER (PARTITION BY load_id, fips ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
k AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY load_id, fips ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT load_id, fips, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS period_start, strftime(max(e), '%Y-%m-%d %H:%M:%S') AS period_end FROM k GROUP BY load_id, fips, g""",
    "p5_profile": f"""{_PANEL}, y AS (
  SELECT *, CASE table_name WHEN 'county_housing_monthly' THEN 2 WHEN 'county_economic_annual' THEN 3 ELSE 6 END AS digits FROM g
), w AS (SELECT *, CAST(round(good * power(10.0, digits)) AS HUGEINT) AS y FROM y),
sums AS (
  SELECT table_name, column_name, load_id, digits, min(good) AS lo, max(good) AS hi, count(y) AS n, coalesce(sum(y), 0) AS s1, coalesce(sum(y * y), 0) AS s2, coalesce(sum(y * y * y), 0) AS s3,
    coalesce(sum((y * y // 1073741824) * (y * y // 1073741824)), 0) AS s4_high, coalesce(sum((y * y // 1073741824) * (y * y % 1073741824)), 0) AS s4_mid, coalesce(sum((y * y % 1073741824) * (y * y % 1073741824)), 0) AS s4_low
  FROM w GROUP BY 1, 2, 3, 4
), rest AS (
  SELECT *, sum(n) OVER c - n AS rn, sum(s1) OVER c - s1 AS r1, sum(s2) OVER c - s2 AS r2, power(10.0, -digits) AS unit FROM sums WINDOW c AS (PARTITION BY table_name, column_name)
), drawn AS (
  SELECT *, CAST(s1 AS DOUBLE) / nullif(n, 0) AS m, CAST(n * s2 - s1 * s1 AS DOUBLE) / nullif(CAST(n AS DOUBLE) * n, 0) AS v,
    CAST(r1 AS DOUBLE) / nullif(rn, 0) AS rm, CAST(rn * r2 - r1 * r1 AS DOUBLE) / nullif(CAST(rn AS DOUBLE) * rn, 0) AS rv,
    CAST(n * n * s3 - 3 * n * s1 * s2 + 2 * s1 * s1 * s1 AS DOUBLE) / nullif(CAST(n AS DOUBLE) * n * n, 0) AS t
  FROM rest
)
SELECT table_name, column_name, load_id, p.n_rows AS rows, p.missing, p.bad, p.n_good AS good, p.distinct_values, lo AS min, hi AS max,
  CAST(s1 AS VARCHAR) AS s1, CAST(s2 AS VARCHAR) AS s2, CAST(s3 AS VARCHAR) AS s3, CAST(s4_high AS VARCHAR) AS s4_high, CAST(s4_mid AS VARCHAR) AS s4_mid, CAST(s4_low AS VARCHAR) AS s4_low,
  p.med AS median, digits, p.missing / p.n_rows AS missing_share, coalesce(p.bad / nullif(p.n_rows - p.missing, 0), 0) AS bad_share, p.distinct_values / nullif(p.n_rows - p.missing, 0) AS distinct_ratio,
  round(m * unit, 6) AS mean, round(sqrt(v) * unit, 6) AS stddev, round(CASE WHEN v > 0 THEN t / power(v, 1.5) END, 6) AS skewness,
  round(CASE WHEN (rm IS NULL AND m IS NOT NULL) OR m = rm THEN 0 ELSE (m - rm) / nullif(sqrt((v + rv) / 2), 0) END, 6) AS standardised_difference
FROM p JOIN drawn USING (table_name, column_name, load_id)""",
    "p5_found": f"""{_PANEL}, q AS (
  SELECT *, missing / n_rows AS ms, coalesce(bad / nullif(n_rows - missing, 0), 0) AS bs, distinct_values / nullif(n_rows - missing, 0) AS dr FROM p
), t AS (SELECT table_name, column_name, median(ms) AS tms, median(med) AS tmed, median(dr) AS tdr FROM q GROUP BY 1, 2)
SELECT q.table_name, q.column_name, q.load_id FROM q JOIN t USING (table_name, column_name)
WHERE abs(ms - tms) > 0.10 + 1e-12 OR bs > 0.10 OR med IS NULL OR abs(med - tmed) > 0.30 * abs(tmed) OR dr < 0.5 * tdr""",
    "p7_found": r"""
WITH a AS (SELECT line_id, regexp_replace(line, '\r$', '') AS l FROM statsamerica_bea_personal_income WHERE line_no IS DISTINCT FROM 1),
b AS (SELECT *, regexp_full_match(l, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS ok FROM a),
c AS (SELECT *, regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM b),
d AS (SELECT *, trim(trim(f[5], '"')) AS y, trim(trim(f[7], '"')) AS v, trim(trim(f[8], '"')) AS s FROM c)
SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 8 THEN 'column_count' ELSE 'invalid_value' END AS reason FROM d
WHERE NOT ok OR len(f) <> 8 OR NOT regexp_full_match(y, '[0-9]{4}') OR TRY_CAST(y AS INT) NOT BETWEEN 1900 AND 2100
   OR (s = '0' AND NOT regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'))""",
}
