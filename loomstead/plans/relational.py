"""Queries of the relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators.events import overlapping_pairs
from loomstead.operators.relational import (
    assert_unique_key, best_match, first_per_key, islands, joined_unique, latest_years, spine_join,
)
from loomstead.operators.windows import unpivot
from loomstead.plans.panel import r6
from loomstead.plans.tables import table


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.col("o_orderdate").cast("date").alias("s"))
    return o.withColumn("e", F.date_add("s", (F.col("o_orderkey") % 90).cast("int")))


def interval_islands(spark: SparkSession, sf: str) -> DataFrame:
    c = islands(_spans(spark, sf), ["o_custkey"], "s", "e", 7, ["o_orderkey"])
    return c.groupBy("o_custkey", "island").agg(F.min("s").alias("first_day"), F.max("e").alias("last_day"), F.count(F.lit(1)).alias("n"))


def representative_in_cluster(spark: SparkSession, sf: str) -> DataFrame:
    c = islands(_spans(spark, sf), ["o_custkey"], "s", "e", 7, ["o_orderkey"])
    return first_per_key(c, ["o_custkey", "island"], [F.col("o_orderpriority"), F.col("s").desc(), F.col("o_orderkey")], "cluster_size").select("o_custkey", "island", "o_orderkey", "cluster_size")


def interval_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return overlapping_pairs(_spans(spark, sf), ["o_custkey"], "o_orderkey", "s", "e")


def cross_source_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the nearest error interval of its user, three hours around."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    errors = ev.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("u"), F.col("ts").alias("es"), (F.col("ts") + F.expr("make_dt_interval(0, 0, cast(floor(value) as int), 0)")).alias("ee"))
    buys = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    wide = F.expr("INTERVAL 3 HOUR")
    near = (F.col("user_id") == F.col("u")) & (F.col("ts") <= F.col("ee") + wide) & (F.col("ts") >= F.col("es") - wide)
    gap = F.abs(F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("es").cast("timestamp")))
    return best_match(buys, errors, near, ["event_id"], [gap, F.col("es"), F.col("error_id")]).select("event_id", "error_id", "user_id")


def dedup_row_number(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return first_per_key(li, ["l_partkey", "l_suppkey"], [F.col("l_extendedprice").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber")], "source_record_count").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "source_record_count")


def spine_join_flags(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    by_part = lambda cond, name: li.filter(cond).groupBy(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias(name))
    return spine_join({"returned": by_part("l_returnflag = 'R'", "returned_n"), "discounted": by_part("l_discount >= 0.09", "discounted_n"), "large": by_part("l_quantity >= 48", "large_n")}, ["part", "year"])


def conditional_pivot(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    kinds = ("click", "view", "purchase", "signup", "error")
    return ev.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"{k}_n") for k in kinds], *[r6(F.max(F.when(F.col("event_type") == k, F.col("value")))).alias(f"{k}_max") for k in kinds[:3]], F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("kind_list"))


def unpivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*[r6(F.avg(c)).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return unpivot(li, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"])


def prioritised_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """County names of the housing panel resolved in the counties of their state: exact, without suffix, then by prefix."""
    from loomstead.functions.text import place_name

    h = table(spark, sf, "county_housing_monthly").select("county_name", "state_code").filter("county_name is not null").distinct()
    h = h.withColumn("label", F.regexp_replace("county_name", r", [A-Z]{2}$", ""))
    ref = table(spark, sf, "ref_counties").select(F.col("fips").alias("ref_fips"), F.col("county_name").alias("ref_name"), F.col("state").alias("state_code"))
    # a fixed reference list joins on the state, so only names of one state are compared
    j = h.join(F.broadcast(ref), "state_code")
    tier = F.when(F.lower("label") == F.lower("ref_name"), 0).when(place_name(F.col("label")) == place_name(F.col("ref_name")), 1).when(F.lower("ref_name").startswith(F.lower(F.split("label", " ")[0])), 2)
    return first_per_key(j.withColumn("tier", tier).filter("tier is not null"), ["county_name", "state_code"], [F.col("tier"), F.col("ref_fips")]).select("county_name", "state_code", "ref_fips", "tier")


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


def anti_semi(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    great = c.join(o.filter("o_totalprice > 400000"), "c_custkey", "left_semi").withColumn("kind", F.lit("great"))
    none = c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("none"))
    return great.unionByName(none)


def full_outer_chunks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    left = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "y").agg(F.count(F.lit(1)).alias("f_n"))
    right = o.filter("o_orderstatus = 'O'").groupBy("o_custkey", "y").agg(F.count(F.lit(1)).alias("o_n"))
    return left.join(right, ["o_custkey", "y"], "full")


def joined_unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(joined_unique("l_partkey", numeric=True).alias("parts"), joined_unique("l_returnflag").alias("flags"))


def suppressed_latest10(spark: SparkSession, sf: str) -> DataFrame:
    from loomstead.plans.hygiene import p7_loaded

    rows = latest_years(p7_loaded(spark, sf), "year", 10).filter("fips is not null and linecode in ('0010', '0020', '0100')")
    return rows.groupBy("fips", "year").agg(*[F.max(F.when((F.col("linecode") == k) & (F.col("disclosure") == "0"), F.col("data"))).alias(f"line_{k}") for k in ("0010", "0020", "0100")], F.count_if(F.col("disclosure") != "0").alias("suppressed_n"))


def unique_key_check(spark: SparkSession, sf: str) -> DataFrame:
    li = assert_unique_key(table(spark, sf, "nation"), ["n_nationkey"])
    return li.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"))


def latest_version_per_key(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return first_per_key(ev, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


def average_duration_imputation(spark: SparkSession, sf: str) -> DataFrame:
    """Events without an end get their type's mean duration in whole days (invalid intervals do not count)."""
    e = table(spark, sf, "extreme_events_county").select("record_id", "event_type", F.col("event_start").cast("date").alias("s"), F.col("event_end").cast("date").alias("e"))
    mean = e.filter("e >= s").groupBy("event_type").agg(F.avg(F.datediff("e", "s")).alias("days"))
    j = e.filter("s is not null").join(mean, "event_type", "left")
    return j.select("record_id", F.coalesce("e", F.date_add("s", F.round("days").cast("int")), "s").alias("end_day"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_islands, representative_in_cluster, interval_overlap_pairs, cross_source_best_match, dedup_row_number, spine_join_flags, conditional_pivot, unpivot_metrics, prioritised_name_match,
        union_by_name, anti_semi, full_outer_chunks, joined_unique_ids, suppressed_latest10, unique_key_check, latest_version_per_key, average_duration_imputation,
    )
}

_SPANS = "o AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS e FROM orders)"
_ISLANDS = f"""WITH {_SPANS}, r AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 7 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM r)"""


def _place(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(replace(lower(trim({c})), 'ñ', 'n'), '&', 'and'), '\\s+', ' ', 'g'), '\\s+(county|parish|city and borough|borough|census area|municipality|city)$', ''))"


_KINDS = ("click", "view", "purchase", "signup", "error")
SQL = {
    "interval_islands": f"{_ISLANDS} SELECT o_custkey, CAST(island AS BIGINT) AS island, min(s) AS first_day, max(e) AS last_day, count(*) AS n FROM i GROUP BY 1, 2",
    "representative_in_cluster": f"{_ISLANDS} SELECT o_custkey, CAST(island AS BIGINT) AS island, o_orderkey, count(*) OVER (PARTITION BY o_custkey, island) AS cluster_size FROM i QUALIFY row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderpriority, s DESC, o_orderkey) = 1",
    "interval_overlap_pairs": f"WITH {_SPANS} SELECT a.o_custkey, a.o_orderkey AS key_a, b.o_orderkey AS key_b FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.e AND b.s <= a.e",
    "cross_source_best_match": """WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id AS error_id, user_id AS u, ts AS es, ts + to_minutes(CAST(floor(value) AS INT)) AS ee FROM events WHERE event_type = 'error')
SELECT event_id, error_id, user_id FROM b JOIN e ON user_id = u AND ts <= ee + INTERVAL 3 HOUR AND ts >= es - INTERVAL 3 HOUR QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(date_diff('second', date_trunc('second', es), date_trunc('second', ts))), es, error_id) = 1""",
    "dedup_row_number": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS source_record_count FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) = 1",
    "spine_join_flags": """WITH a AS (SELECT l_partkey AS part, year(l_shipdate) AS year, count(*) AS returned_n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_partkey AS part, year(l_shipdate) AS year, count(*) AS discounted_n FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1, 2),
c AS (SELECT l_partkey AS part, year(l_shipdate) AS year, count(*) AS large_n FROM lineitem WHERE l_quantity >= 48 GROUP BY 1, 2), k AS (SELECT part, year FROM a UNION SELECT part, year FROM b UNION SELECT part, year FROM c)
SELECT k.part, k.year, returned_n, a.part IS NOT NULL AS has_returned, discounted_n, b.part IS NOT NULL AS has_discounted, large_n, c.part IS NOT NULL AS has_large FROM k LEFT JOIN a USING (part, year) LEFT JOIN b USING (part, year) LEFT JOIN c USING (part, year)""",
    "conditional_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}_n" for k in _KINDS) + ", " + ", ".join(f"round(max(value) FILTER (event_type = '{k}'), 6) AS {k}_max" for k in _KINDS[:3]) + ", count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS kind_list FROM events GROUP BY 1",
    "unpivot_metrics": "WITH a AS (SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, metric_name, metric_value FROM (UNPIVOT a ON l_quantity, l_discount, l_tax INTO NAME metric_name VALUE metric_value)",
    "prioritised_name_match": f"""WITH h AS (SELECT DISTINCT county_name, state_code, regexp_replace(county_name, ', [A-Z][A-Z]$', '') AS label FROM county_housing_monthly WHERE county_name IS NOT NULL),
j AS (SELECT h.county_name, h.state_code, r.fips AS ref_fips, CASE WHEN lower(label) = lower(r.county_name) THEN 0 WHEN {_place("replace(replace(label, '.', ''), '''', '')")} = {_place("replace(replace(r.county_name, '.', ''), '''', '')")} THEN 1 WHEN starts_with(lower(r.county_name), lower(split_part(label, ' ', 1))) THEN 2 END AS tier FROM h JOIN ref_counties r ON r.state = h.state_code)
SELECT county_name, state_code, ref_fips, tier FROM j WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY county_name, state_code ORDER BY tier, ref_fips) = 1""",
    "union_by_name": "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier",
    "anti_semi": "SELECT c_custkey, c_nationkey, 'great' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) UNION ALL SELECT c_custkey, c_nationkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "full_outer_chunks": "WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS f_n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), o AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS o_n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) SELECT o_custkey, y, f_n, o_n FROM f FULL JOIN o USING (o_custkey, y)",
    "joined_unique_ids": "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), '|') AS parts, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1",
    "suppressed_latest10": r"""WITH a AS (SELECT regexp_replace(line, '\r$', '') AS l FROM statsamerica_bea_personal_income WHERE line_no IS DISTINCT FROM 1), b AS (SELECT *, regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM a WHERE regexp_full_match(l, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*')),
d AS (SELECT trim(trim(f[1], '"')) AS g, trim(trim(f[5], '"')) AS y, trim(trim(f[6], '"')) AS k, trim(trim(f[7], '"')) AS v, trim(trim(f[8], '"')) AS s FROM b WHERE len(f) = 8),
r AS (SELECT lpad(g, 5, '0') AS fips, CAST(y AS INT) AS year, k, s, CASE WHEN s = '0' THEN TRY_CAST(v AS DOUBLE) END AS v, g FROM d WHERE regexp_full_match(y, '[0-9]{4}') AND TRY_CAST(y AS INT) BETWEEN 1900 AND 2100 AND (s <> '0' OR regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')))
SELECT fips, year, max(v) FILTER (k = '0010') AS line_0010, max(v) FILTER (k = '0020') AS line_0020, max(v) FILTER (k = '0100') AS line_0100, count(*) FILTER (s <> '0') AS suppressed_n FROM r
WHERE year >= (SELECT max(year) FROM r) - 9 AND regexp_full_match(g, '[0-9]{1,5}') AND k IN ('0010', '0020', '0100') GROUP BY 1, 2""",
    "unique_key_check": "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1",
    "latest_version_per_key": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "average_duration_imputation": """WITH e AS (SELECT record_id, event_type, CAST(event_start AS DATE) AS s, CAST(event_end AS DATE) AS e FROM extreme_events_county), m AS (SELECT event_type, avg(date_diff('day', s, e)) AS days FROM e WHERE e >= s GROUP BY 1)
SELECT record_id, coalesce(e.e, e.s + CAST(round(days) AS INT), e.s) AS end_day FROM e LEFT JOIN m ON m.event_type = e.event_type WHERE e.s IS NOT NULL""",
}
