"""The catalog of features: where each is, what it is made of, and whether the model keeps it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "feature.county_economic_annual": (
        "annual",
        ("median_household_income_usd", "unemployment_rate_pct", "median_home_value_usd", "median_gross_rent_usd_month", "median_owner_costs_mortgage_usd_month", "housing_cost_pct_income",
         "owner_cost_burden_30pct_plus_pct", "median_property_taxes_usd_year", "homeowners_insurance_pct_income", "property_taxes_pct_income", "utilities_pct_income", "per_capita_personal_income_usd",
         "net_earnings_per_capita_usd", "earnings_by_place_of_work_per_capita_usd", "dividends_interest_rent_per_capita_usd", "transfer_receipts_per_capita_usd", "average_annual_wage_usd"),
    ),
    "feature.county_demographic_annual": ("annual", ("total_population", "age_65_plus_pct", "disability_pct", "communication_barrier_pct", "no_broadband_pct", "total_net_migration", "net_migration_rate_pct")),
    "feature.county_climate_monthly": ("monthly", ("fema_event_count", "noaa_extreme_event_count", "extreme_event_count", "noaa_extreme_damage_usd")),
    "feature.county_housing_monthly": (
        "monthly",
        ("median_sale_price_usd", "median_ppsf_usd", "median_ppsf_yoy", "avg_sale_to_list_yoy", "homes_sold_yoy", "inventory_yoy", "new_listings_yoy", "median_dom_yoy", "price_drops_yoy", "housing_market_index"),
    ),
    "feature.county_risk": ("current", ("risk_score", "risk_rating", "community_resilience_score", "expected_annual_loss_score", "social_vulnerability_score")),
}
COMBINED, POPULATION, DISPLAY = "counted in extreme_event_count", "defines the groups compared", "not shown within a risk group"
#: Features that are made but not kept for the model.
NOT_KEPT = {
    "fema_event_count": COMBINED, "noaa_extreme_event_count": COMBINED, "risk_rating": POPULATION, "risk_score": DISPLAY, "community_resilience_score": DISPLAY,
    "expected_annual_loss_score": DISPLAY, "social_vulnerability_score": DISPLAY, "median_home_value_usd": DISPLAY, "median_gross_rent_usd_month": DISPLAY,
    "median_owner_costs_mortgage_usd_month": DISPLAY, "price_drops_yoy": DISPLAY, "housing_cost_pct_income": "its components are kept", "median_property_taxes_usd_year": "kept as a share of income",
    "per_capita_personal_income_usd": "its components are kept", "net_earnings_per_capita_usd": "earnings by place of work are kept",
}
#: Measures thought of that are in no table.
ELSEWHERE = {"median_ppsf_yoy_ten_year_average": "repeats the outcome", "accommodation_food_wage_share": "left out of the comparison"}


def unit_of(name: str) -> str:
    ends = (("_usd_month", "USD a month"), ("_usd_year", "USD a year"), ("_usd", "USD"), ("_pct", "percent"), ("_pct_income", "percent of income"), ("_yoy", "proportion"), ("_count", "count"), ("_score", "score"), ("_index", "standard deviations"), ("_rating", "label"))
    return next((u for e, u in ends if name.endswith(e)), "count")


def feature_catalog(spark: SparkSession) -> DataFrame:
    rows = [(t, f, grain, unit_of(f), f not in NOT_KEPT, NOT_KEPT.get(f)) for t, (grain, fs) in TABLES.items() for f in fs]
    rows += [(None, f, "ten years" if "ten_year" in f else "annual", unit_of(f), False, why) for f, why in ELSEWHERE.items()]
    return spark.createDataFrame(rows, "feature_table string, feature_name string, temporal_grain string, unit string, retained boolean, exclusion_reason string")
