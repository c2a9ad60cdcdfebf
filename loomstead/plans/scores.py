"""Queries of ranks, correlations, cleaning rules, scorecards and profiles over the star schema and the county tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loomstead.functions import clean, text
from loomstead.operators import playbook, quality, stats
from loomstead.operators.relational import average_rank, equal_groups, percent_rank_average, top_with_minimum
from loomstead.plans.panel import RATINGS, located_orders, panel, r6, rating
from loomstead.plans.tables import table


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def percent_rank_avg(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf).withColumn("band", F.floor(F.col("c_acctbal") / 100))
    return c.select("c_custkey", percent_rank_average("band", ["c_nationkey"]).alias("pct_rank"), average_rank("band", ["c_nationkey"]).alias("avg_rank"))


def equal_groups4(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf).select("c_custkey", "c_nationkey", equal_groups(["c_nationkey"], [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")]).alias("subgroup"))


def topk_topup(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf)
    z = c.groupBy("c_nationkey", "c_mktsegment").agg(r6(F.avg("c_acctbal") / 5000 - 0.9).alias("score"))
    return top_with_minimum(z, ["c_nationkey"], "score", 0.05, 3, ["c_mktsegment"]).select("c_nationkey", "c_mktsegment", "score", "rn")


def spearman_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.spearman(located_orders(spark, sf), ["region"], "o_totalprice", "c_acctbal")
    return out.select("region", "pairs", r6("rho").alias("rho"))


def trend_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("t", F.year("period") * 12 + F.month("period"))
    return stats.trend(p, ["unit"], "t", "orders_n").select("unit", "n", r6("slope").alias("slope"), r6("r2").alias("r2"))


def iqr_fence_trend(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("x"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    kept = stats.within_fences(li.join(part, "l_partkey"), ["p_brand"], ["q", "x"])
    return stats.trend(kept, ["p_brand"], "q", "x").select("p_brand", "n", F.round("slope", 4).alias("slope"), r6("r2").alias("r2"))


def robust_caps(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    return stats.robust_clamp(o, "v").select("o_orderkey", r6("capped").alias("capped"))


def subgroup_share_above_median(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf).withColumn("subgroup", equal_groups(["c_nationkey"], [F.col("c_custkey")]))
    out = playbook.share_above(c, ["c_nationkey"], "subgroup", "c_acctbal")
    return out.select("c_nationkey", "subgroup", r6("above_pct").alias("above_pct"), r6("below_pct").alias("below_pct"))


def _unit_facts(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).groupBy("unit").agg(F.median("median_price").alias("price"), F.avg("orders_n").alias("volume")).withColumn("risk_rating", rating("unit"))
    peers = p.groupBy("risk_rating").agg(F.median("price").alias("peer_price"), F.median("volume").alias("peer_volume"))
    return p.join(peers, "risk_rating")


def factor_position(spark: SparkSession, sf: str) -> DataFrame:
    f = _unit_facts(spark, sf).withColumn("position", playbook.factor_position(F.col("price"), F.col("peer_price")))
    return f.select("unit", "risk_rating", "position", playbook.factor_growth(F.col("position"), F.lit(-0.4)).alias("growth"))


def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    f = _unit_facts(spark, sf)
    balance = sum((playbook.factor_growth(playbook.factor_position(F.col(a), F.col(b)), F.lit(rho)) for a, b, rho in (("price", "peer_price", 0.5), ("volume", "peer_volume", 0.3))), F.lit(0))
    performer = F.when(F.col("price") >= F.col("peer_price"), "Overperformer").otherwise("Underperformer")
    return f.select("unit", "risk_rating", balance.cast("int").alias("balance"), playbook.scorecard(F.col("risk_rating"), performer, balance).alias("level"))


def sufficient_history(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "county_housing_monthly").withColumn("v", clean.finite(clean.sentinel_null("homes_sold_yoy")))
    return playbook.sufficient_history(h, ["load_id", "county_name"], "v", 0.9).select("load_id", "county_name", r6("share").alias("share"))


def subgroup_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's balance assigned to the nearest of its segment's balance ranges."""
    c = _customers(spark, sf)
    ranges = c.groupBy("c_nationkey", "c_mktsegment").agg(F.percentile("c_acctbal", F.lit(0.4)).alias("lo"), F.percentile("c_acctbal", F.lit(0.6)).alias("hi"))
    j = c.select("c_custkey", "c_nationkey", "c_acctbal").join(F.broadcast(ranges), "c_nationkey")  # nations times segments: fixed
    inside, distance = playbook.subgroup_from_ranges(F.col("c_acctbal"), F.col("lo"), F.col("hi"))
    j = j.withColumn("inside", inside).withColumn("distance", distance)
    best = j.groupBy("c_custkey").agg(F.min(F.struct("inside", "distance", "c_mktsegment")).alias("b"))
    return best.select("c_custkey", F.col("b.c_mktsegment").alias("segment"), r6("b.distance").alias("distance"))


def weighted_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    bins = {"b1": (1, 10, 5.5), "b2": (11, 25, 18.0), "b3": (26, 40, 33.0), "b4": (41, 50, 45.5)}
    counts = li.groupBy("s_nationkey").agg(*[F.count_if(F.col("l_quantity").between(lo, hi)).cast("string").alias(b) for b, (lo, hi, _) in bins.items()])
    return counts.groupBy("s_nationkey").agg(r6(clean.weighted_midpoint({b: m for b, (_, _, m) in bins.items()})).alias("avg_quantity"))


def weighted_bucket(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_quantity") < 20).alias("low"), F.count_if(F.col("l_quantity") > 40).alias("high"), F.count_if(F.col("l_quantity").between(20, 40)).alias("rest"))
    return li.select("l_returnflag", "l_linestatus", r6(clean.weighted_bucket_average({"low": 10.0, "high": 45.0}, ["rest"])).alias("avg_bucket"))


def null_negative_clean(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("balance_amount"), F.col("c_acctbal").alias("balance_change"))
    return clean.clean_negatives(c).select("c_custkey", r6(F.col("balance_amount").cast("double")).alias("balance_amount"), "balance_change")


def bounded_percent(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "county_demographic_annual")
    return d.select("row_id", r6(clean.bounded_percent(clean.finite("disability_pct").cast("string"))).alias("disability_share"), r6(clean.finite(clean.sentinel_null("net_migration_rate_pct"))).alias("migration_pct"))


def sentinel_null(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "county_housing_monthly")
    cols = ("median_ppsf_yoy", "inventory_yoy", "housing_market_index")
    return h.groupBy("load_id").agg(*[x for c in cols for x in (F.count(clean.finite(clean.sentinel_null(c))).alias(f"{c}_n"), r6(F.min(clean.finite(clean.sentinel_null(c)))).alias(f"{c}_min"))])


def special_codes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "county_economic_annual")
    return e.select("row_id", clean.special_codes_null("dp03_median_household_income_usd").alias("income_text"), r6(clean.number(clean.special_codes_null("dp03_median_household_income_usd"))).alias("income"))


def label_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extreme_events_county").select("record_id", text.event_name(F.col("event_name")).alias("label"))


def event_family(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extreme_events_county")
    return e.groupBy("event_type", text.event_family(F.col("event_type"), F.col("event_name")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def place_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ref_counties").select("fips", text.place_name(F.col("county_name")).alias("place"), text.county_label(F.col("county_name")).alias("label"))


def damage_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    raw = F.when(F.col("p_size") % 5 == 0, F.lit("")).when(F.col("p_size") % 5 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".00K"))).when(F.col("p_size") % 5 == 2, F.concat(F.col("p_size").cast("string"), F.lit(".5m"))).when(F.col("p_size") % 5 == 3, F.concat(F.col("p_size").cast("string"), F.lit("B"))).otherwise(F.lit("abc"))
    return p.select("p_partkey", clean.damage_amount(raw).alias("damage"))


def rating_relabel(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Relatively Low", "Relatively Moderate", "Relatively High", "Very High", "Insufficient Data")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return n.select("n_nationkey", clean.rating_label(raw).alias("label"), clean.rating_rank(clean.rating_label(raw)).alias("rank"))


def year_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the dp02 files from the column that carries them in each year, by the variable table."""
    from loomstead.plans.hygiene import p6_table

    routes = [(r["year"], r["raw_column"], r["feature_name"]) for r in table(spark, sf, "acs_variable_features").orderBy("year", "variable").collect()]  # a fixed list of variables
    rows = p6_table(spark, sf).filter("year is not null")
    feats = sorted({f for _, c, f in routes if c in rows.columns})
    return rows.groupBy("year").agg(*[F.count(clean.year_routed([(y, c) for y, c, g in routes if g == f and c in rows.columns])).alias(f) for f in feats])


def profile_missingness(spark: SparkSession, sf: str) -> DataFrame:
    m = quality.missingness(table(spark, sf, "extreme_events_county"), ["fips", "event_type", "event_name", "event_start", "event_end", "event_key", "source_record_count"])
    return m.select("column_name", "rows", "nulls", r6("null_pct").alias("null_pct"))


def profile_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    d = quality.distribution(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("column_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "p01", "p25", "p50", "p75", "p99")], "outliers")


def profile_missingness_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extreme_events_county")
    return quality.missingness(e, e.columns).select("column_name", "rows", "nulls", r6("null_pct").alias("null_pct"))


def profile_quantiles_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    """All numeric columns, keys among them."""
    rows = table(spark, sf, "lineitem")
    d = quality.distribution(rows, [f.name for f in rows.schema if isinstance(f.dataType, NumericType)])
    return d.select("column_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "p01", "p25", "p50", "p75", "p99")], "outliers")


def corr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = quality.correlation_pairs(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 100, 30)
    return c.select("column_a", "column_b", "pairs", r6("r").alias("r"))


def coverage_by_period(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "county_economic_annual")
    c = quality.coverage(e, "year", "fips", ["has_acs_affordability", "has_acs_economic"])
    return c.select("year", "units", r6("has_acs_affordability_pct").alias("affordability_pct"), r6("has_acs_economic_pct").alias("economic_pct"))


def json_payload(spark: SparkSession, sf: str) -> DataFrame:
    """One compact JSON text per rating with its monthly medians, as the page bundles have them."""
    s = playbook.group_series(panel(spark, sf).withColumn("risk_rating", rating("unit")), "risk_rating", "period", "median_price")
    points = F.array_sort(F.collect_list(F.struct(F.date_format("period", "yyyy-MM").alias("month"), F.col("median").alias("median"))))
    return s.groupBy("risk_rating").agg(F.to_json(points).alias("payload")).withColumn("fingerprint", F.substring(F.sha2("payload", 256), 1, 12))


def _rated_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf)
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"))
    return c.join(spend, "c_custkey").withColumn("risk_rating", rating("c_nationkey"))


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    seed = F.lit(20260814) + 100 * (F.array_position(F.array(*[F.lit(x) for x in RATINGS]), F.col("risk_rating")) - 1)
    return stats.bootstrap_interval(_rated_customers(spark, sf).withColumn("seed", seed), ["risk_rating"], "c_acctbal", "spend", "seed")


def peer_picker(spark: SparkSession, sf: str) -> DataFrame:
    c = _rated_customers(spark, sf).withColumn("pct_rank", percent_rank_average("spend", ["risk_rating"]))
    c = c.withColumn("eligible", F.col("c_acctbal") > 0).withColumn("deviation", F.abs("c_acctbal")).withColumn("mean_deviation", F.col("deviation") / 2)
    return stats.spaced_peers(c, "risk_rating", "c_custkey", "c_nationkey", "pct_rank", "eligible", "deviation", "mean_deviation")


def best_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Per rating the two units whose monthly medians contrast best: consistent and wide first, then the wider average gap."""
    p = panel(spark, sf).withColumn("risk_rating", rating("unit")).select("risk_rating", "unit", "period", "median_price")
    sd = p.groupBy("risk_rating").agg(F.stddev_samp("median_price").alias("sd"))
    a, b = p.alias("a"), p.alias("b")
    # units of one rating met month by month: as many pairs as a rating has units, whatever the data
    j = a.join(b, [F.col("a.risk_rating") == F.col("b.risk_rating"), F.col("a.period") == F.col("b.period"), F.col("a.unit") < F.col("b.unit")]).join(sd.withColumnRenamed("risk_rating", "rr"), F.col("a.risk_rating") == F.col("rr"))
    delta = (F.col("a.median_price") - F.col("b.median_price")) / F.col("sd")
    s = j.groupBy(F.col("a.risk_rating").alias("risk_rating"), F.col("a.unit").alias("unit_a"), F.col("b.unit").alias("unit_b")).agg(
        r6(F.median(F.abs(delta))).alias("contrast"), r6(F.greatest(F.avg((delta > 0).cast("double")), F.avg((delta < 0).cast("double")))).alias("consistent_share"), r6(F.abs(F.avg(delta))).alias("gap")
    )
    good = ((F.col("consistent_share") >= 0.7) & (F.col("contrast") >= 0.5)).cast("int")
    score = F.struct(good.alias("g"), F.when(good == 1, F.col("contrast")).otherwise(F.col("consistent_share")).alias("x"), F.when(good == 1, F.col("consistent_share")).otherwise(F.col("contrast")).alias("y"), F.col("gap").alias("z"), (-F.col("unit_a")).alias("a"), (-F.col("unit_b")).alias("b"))
    best = s.groupBy("risk_rating").agg(F.max_by(F.struct("unit_a", "unit_b", "contrast", "consistent_share", "gap"), score).alias("s"))
    return best.select("risk_rating", "s.*")


def volatility_check(spark: SparkSession, sf: str) -> DataFrame:
    """Units without a clear trend whose deviation stands out of their group's."""
    p = panel(spark, sf).withColumn("risk_rating", rating("unit")).withColumn("t", (F.year("period") * 12 + F.month("period")).cast("double"))
    t = stats.trend(p, ["risk_rating", "unit"], "t", "median_price")
    sd = p.groupBy("unit").agg(F.stddev_samp("median_price").alias("sd"))
    grp = sd.withColumn("risk_rating", rating("unit")).groupBy("risk_rating").agg(F.median("sd").alias("group_sd"))
    j = t.join(sd, "unit").join(grp, "risk_rating")
    return j.select("unit", "n", r6("sd").alias("sd"), r6("r2").alias("r2"), ((F.col("n") >= 12) & (F.col("r2") < 0.08) & (F.col("sd") > 1.05 * F.col("group_sd"))).alias("volatile"))


QUERIES = {
    f.__name__: f
    for f in (
        percent_rank_avg, equal_groups4, topk_topup, spearman_by_group, trend_stats, iqr_fence_trend, robust_caps, subgroup_share_above_median, factor_position, scorecard, sufficient_history,
        subgroup_ranges, weighted_midpoint, weighted_bucket, null_negative_clean, bounded_percent, sentinel_null, special_codes, label_normalise, event_family, place_name, damage_parse, rating_relabel,
        year_routing, profile_missingness, profile_missingness_all_columns, profile_quantiles, profile_quantiles_all_columns, corr_pairs, coverage_by_period, json_payload, bootstrap_ci, peer_picker, best_pair, volatility_check,
    )
}

from loomstead.plans.panel import _LOCATED, _PANEL, _RATING  # noqa: E402

_RANKED = "(rank() OVER (PARTITION BY {g} ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0)"
_FACTS = f"""WITH {_PANEL}, f AS (SELECT unit, {_RATING.format('unit')} AS risk_rating, median(median_price) AS price, avg(orders_n) AS volume FROM panel GROUP BY 1, 2), m AS (SELECT risk_rating, median(price) AS pp, median(volume) AS pv FROM f GROUP BY 1), j AS (SELECT * FROM f JOIN m USING (risk_rating))"""
_SEN = "CASE WHEN isnan({0}) OR {0} <= -888888000 THEN NULL ELSE {0} END"
_SPECIAL = "CASE WHEN replace(dp03_median_household_income_usd, ',', '') IN ({}) THEN NULL ELSE dp03_median_household_income_usd END".format(", ".join(f"'{n}', '{n}.0'" for n in clean.SPECIAL_CODES))
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{f}'" for f, p in text.FAMILIES) + " ELSE coalesce(nullif(t, ''), 'other') END"
_LABEL = "coalesce(trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g')), '')"


def _dist(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.01), 4) AS p01, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.99), 4) AS p99,
  (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers FROM lineitem"""


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SQL = {
    "percent_rank_avg": f"WITH c AS (SELECT c_custkey, c_nationkey, floor(c_acctbal / 100) AS band FROM customer), r AS (SELECT c_custkey, {_RANKED.format(g='c_nationkey', v='band')} AS a, count(band) OVER (PARTITION BY c_nationkey) AS n FROM c) SELECT c_custkey, round(a / n * 100, 1) AS pct_rank, a AS avg_rank FROM r",
    "equal_groups4": "SELECT c_custkey, c_nationkey, CAST(least(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) - 1) * 4 / count(*) OVER (PARTITION BY c_nationkey)), 3) AS INT) AS subgroup FROM customer",
    "topk_topup": "WITH z AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal) / 5000 - 0.9, 6) AS score FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(score) DESC, c_mktsegment) AS rn, count(*) FILTER (abs(score) >= 0.05) OVER (PARTITION BY c_nationkey) AS n FROM z) SELECT c_nationkey, c_mktsegment, score, rn FROM r WHERE rn <= greatest(3, n)",
    "spearman_by_group": f"WITH {_LOCATED}, r AS (SELECT region, {_RANKED.format(g='region', v='o_totalprice')} AS x, {_RANKED.format(g='region', v='c_acctbal')} AS y FROM located WHERE o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL) SELECT region, count(*) AS pairs, round(corr(x, y), 6) AS rho FROM r GROUP BY 1",
    "trend_stats": f"WITH {_PANEL}, p AS (SELECT unit, year(period) * 12 + month(period) AS t, orders_n FROM panel) SELECT unit, count(*) AS n, round(regr_slope(orders_n, t), 6) AS slope, round(regr_r2(orders_n, t), 6) AS r2 FROM p GROUP BY 1",
    "iqr_fence_trend": """WITH l AS (SELECT p_brand, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT p_brand, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.75) AS q3, quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x3 FROM l GROUP BY 1),
k AS (SELECT l.* FROM l JOIN f USING (p_brand) WHERE q BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AND x BETWEEN x1 - 1.5 * (x3 - x1) AND x3 + 1.5 * (x3 - x1)) SELECT p_brand, count(*) AS n, round(regr_slope(x, q), 4) AS slope, round(regr_r2(x, q), 6) AS r2 FROM k GROUP BY 1""",
    "robust_caps": "WITH c AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 6) AS capped FROM orders, c",
    "subgroup_share_above_median": "WITH s AS (SELECT *, CAST(least(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 4 / count(*) OVER (PARTITION BY c_nationkey)), 3) AS INT) AS subgroup FROM customer), m AS (SELECT c_nationkey, median(c_acctbal) AS m FROM s GROUP BY 1) SELECT c_nationkey, subgroup, round(count(*) FILTER (c_acctbal > m) * 100.0 / count(*), 6) AS above_pct, round(count(*) FILTER (c_acctbal < m) * 100.0 / count(*), 6) AS below_pct FROM s JOIN m USING (c_nationkey) GROUP BY 1, 2",
    "factor_position": f"{_FACTS} SELECT unit, risk_rating, CASE WHEN price > pp THEN 'Higher' WHEN price < pp THEN 'Lower' ELSE 'At peer median' END AS position, CASE WHEN price > pp THEN -1 WHEN price < pp THEN 1 ELSE 0 END AS growth FROM j",
    "scorecard": f"""{_FACTS}, b AS (SELECT *, CAST(sign(price - pp) + sign(volume - pv) AS INT) AS balance FROM j), p AS (SELECT *, (CASE WHEN risk_rating IN ('Very Low', 'Low') THEN 1 ELSE 0 END) + (CASE WHEN price >= pp THEN 1 ELSE 0 END) + (CASE WHEN balance > 0 THEN 1 ELSE 0 END) AS s FROM b)
SELECT unit, risk_rating, balance, CASE s WHEN 3 THEN 'Low' WHEN 2 THEN 'Moderate' ELSE 'High' END AS level FROM p""",
    "sufficient_history": f"SELECT load_id, county_name, round(avg(CASE WHEN {_SEN.format('homes_sold_yoy')} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM county_housing_monthly GROUP BY 1, 2 HAVING avg(CASE WHEN {_SEN.format('homes_sold_yoy')} IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9",
    "subgroup_ranges": """WITH r AS (SELECT c_nationkey, c_mktsegment, quantile_cont(c_acctbal, 0.4) AS lo, quantile_cont(c_acctbal, 0.6) AS hi FROM customer GROUP BY 1, 2), j AS (SELECT c_custkey, r.c_mktsegment AS segment, CASE WHEN c.c_acctbal BETWEEN lo AND hi THEN 0 ELSE 1 END AS i, round(greatest(lo - c.c_acctbal, c.c_acctbal - hi, 0), 12) AS d FROM customer c JOIN r USING (c_nationkey))
SELECT c_custkey, segment, round(d, 6) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY i, d, segment) = 1""",
    "weighted_midpoint": "WITH b AS (SELECT s_nationkey, count(*) FILTER (l_quantity BETWEEN 1 AND 10) AS b1, count(*) FILTER (l_quantity BETWEEN 11 AND 25) AS b2, count(*) FILTER (l_quantity BETWEEN 26 AND 40) AS b3, count(*) FILTER (l_quantity BETWEEN 41 AND 50) AS b4 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) SELECT s_nationkey, round((b1 * 5.5 + b2 * 18.0 + b3 * 33.0 + b4 * 45.5)::DOUBLE / nullif(b1 + b2 + b3 + b4, 0), 6) AS avg_quantity FROM b",
    "weighted_bucket": "WITH b AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity < 20) AS low, count(*) FILTER (l_quantity > 40) AS high, count(*) FILTER (l_quantity BETWEEN 20 AND 40) AS rest FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, round((low * 10.0 + high * 45.0)::DOUBLE / (low + high + rest), 6) AS avg_bucket FROM b",
    "null_negative_clean": "SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, 6) AS balance_amount, c_acctbal AS balance_change FROM customer",
    "bounded_percent": f"SELECT row_id, round(CASE WHEN disability_pct BETWEEN 0 AND 100 THEN disability_pct / 100.0 END, 6) AS disability_share, round({_SEN.format('net_migration_rate_pct')}, 6) AS migration_pct FROM county_demographic_annual",
    "sentinel_null": "SELECT load_id, " + ", ".join(f"count({_SEN.format(c)}) AS {c}_n, round(min({_SEN.format(c)}), 6) AS {c}_min" for c in ("median_ppsf_yoy", "inventory_yoy", "housing_market_index")) + " FROM county_housing_monthly GROUP BY 1",
    "special_codes": f"SELECT row_id, {_SPECIAL} AS income_text, round(TRY_CAST(replace(trim({_SPECIAL}), ',', '') AS DOUBLE), 6) AS income FROM county_economic_annual",
    "label_normalise": f"SELECT record_id, {_LABEL.format('event_name')} AS label FROM extreme_events_county",
    "event_family": f"WITH e AS (SELECT event_type, {_LABEL.format('event_type')} AS t, {_LABEL.format('event_type')} || ' ' || {_LABEL.format('event_name')} AS x FROM extreme_events_county) SELECT event_type, {_FAMILY} AS family, count(*) AS n FROM e GROUP BY 1, 2",
    "place_name": r"""SELECT fips, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(trim(county_name)), 'ñ', 'n'), '&', 'and'), '.', ''), '''', ''), '\s+', ' ', 'g'), '\s+(county|parish|city and borough|borough|census area|municipality|city)$', '')) AS place,
  trim(regexp_replace(trim(regexp_replace(upper(county_name), '[^A-Z0-9]+', ' ', 'g')), ' (CITY AND BOROUGH|CENSUS AREA|MUNICIPALITY|BOROUGH|PARISH|COUNTY|CITY)$', '')) AS label FROM ref_counties""",
    "damage_parse": "SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN p_size * 1e3 WHEN 2 THEN (p_size + 0.5) * 1e6 WHEN 3 THEN p_size * 1e9 ELSE 0.0 END::DOUBLE AS damage FROM part",
    "rating_relabel": "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Very High' ELSE 'Insufficient Data' END AS label, CASE n_nationkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 END AS rank FROM nation",
    "profile_missingness": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM extreme_events_county" for c in ("fips", "event_type", "event_name", "event_start", "event_end", "event_key", "source_record_count")),
    "profile_quantiles": " UNION ALL ".join(map(_dist, ("l_quantity", "l_extendedprice", "l_discount"))),
    "corr_pairs": " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS pairs, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]),
    "coverage_by_period": "SELECT year, count(DISTINCT fips) AS units, round(avg(has_acs_affordability::INT) * 100, 6) AS affordability_pct, round(avg(has_acs_economic::INT) * 100, 6) AS economic_pct FROM county_economic_annual GROUP BY 1",
    "best_pair": f"""WITH {_PANEL}, p AS (SELECT *, {_RATING.format('unit')} AS risk_rating FROM panel), sd AS (SELECT risk_rating, stddev_samp(median_price) AS sd FROM p GROUP BY 1),
d AS (SELECT a.risk_rating, a.unit AS unit_a, b.unit AS unit_b, (a.median_price - b.median_price) / sd AS d FROM p a JOIN p b ON a.risk_rating = b.risk_rating AND a.period = b.period AND a.unit < b.unit JOIN sd ON sd.risk_rating = a.risk_rating),
s AS (SELECT risk_rating, unit_a, unit_b, round(median(abs(d)), 6) AS contrast, round(greatest(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END)), 6) AS consistent_share, round(abs(avg(d)), 6) AS gap FROM d GROUP BY 1, 2, 3),
g AS (SELECT *, consistent_share >= 0.7 AND contrast >= 0.5 AS g FROM s)
SELECT risk_rating, unit_a, unit_b, contrast, consistent_share, gap FROM g QUALIFY row_number() OVER (PARTITION BY risk_rating ORDER BY g DESC, CASE WHEN g THEN contrast ELSE consistent_share END DESC, CASE WHEN g THEN consistent_share ELSE contrast END DESC, gap DESC, unit_a, unit_b) = 1""",
    "volatility_check": f"""WITH {_PANEL}, p AS (SELECT *, {_RATING.format('unit')} AS risk_rating, year(period) * 12 + month(period) AS t FROM panel), u AS (SELECT unit, risk_rating, count(*) AS n, stddev_samp(median_price) AS sd, regr_r2(median_price, t) AS r2 FROM p GROUP BY 1, 2), g AS (SELECT risk_rating, median(sd) AS gs FROM u GROUP BY 1)
SELECT unit, n, round(sd, 6) AS sd, round(r2, 6) AS r2, n >= 12 AND r2 < 0.08 AND sd > 1.05 * gs AS volatile FROM u JOIN g USING (risk_rating)""",
}
