"""Queries of this subpackage over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.eventkeys import PARTS, source_keys, with_identity, with_key_parts
from loomstead.llm.encoding import count_tokens, decode_ids, encode_texts
from loomstead.llm.linkage import connected_groups, shared_name_edges
from loomstead.llm.packing import pack_items
from loomstead.llm.pii import find_met, finder_of, meet_candidates, redact_met
from loomstead.llm.survivorship import surviving_values
from loomstead.operators.skew import skew_join
from loomstead.plans.tables import table
from loomstead.session import cut_lineage

SURVIVING_FIELDS = ("total_damage_amount", "source_record_count", "semantic_duplicate_count")
CAPACITY = 2_048
#: One record in so many has its time withheld from p1_currency.
WITHHELD = 3


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_identity(table(spark, sf_dir, "extreme_events_county"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving value of each field of each group with the record it comes from and the evidence."""
    return surviving_values(_identified(spark, sf_dir), ["load_id", *PARTS], "record_id", "loaded_at", SURVIVING_FIELDS).drop("timed_value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_survivors(spark, sf_dir).select("group_id", "field_name", "record_id")


def p1_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group, built field by field from the survivors; a field without valid values is null."""
    kept = p1_survivors(spark, sf_dir)
    return kept.groupBy("group_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in SURVIVING_FIELDS])


def p1_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What currency reasoning is worth: survivors with the times of one record in WITHHELD hidden, beside the true latest values.

    The hidden times are those of records that a hash of their id picks. found_value is the value that
    survives without them, timed_value the one that the times left would give alone, true_value the one
    with all times.
    """
    rows = cut_lineage(_identified(spark, sf_dir).select("record_id", "load_id", *PARTS, "loaded_at", *SURVIVING_FIELDS))
    hidden = rows.withColumn("loaded_at", F.when(F.pmod(F.xxhash64("record_id"), F.lit(WITHHELD)) != 0, F.col("loaded_at")))
    of = lambda df: surviving_values(df, ["load_id", *PARTS], "record_id", "loaded_at", SURVIVING_FIELDS)
    truth = of(rows).select("group_id", "field_name", F.col("value").alias("true_value"))
    return of(hidden).join(truth, ["group_id", "field_name"]).select(
        "group_id", "field_name", F.col("value").alias("found_value"), "timed_value", "true_value", "evidence"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one own source key are one vertex, that of the least of them; lists and pairs link vertices."""
    records = _identified(spark, sf_dir).select("record_id", "load_id", "county", F.concat_ws(":", "source", "source_id").alias("own"), "month", "associated_source_event_keys")
    records = records.filter("county is not null").withColumn("named", F.array_remove(source_keys("associated_source_event_keys"), F.col("own")))
    # keys are cut and lists are read once
    records = cut_lineage(records.drop("associated_source_event_keys"))
    key = ["load_id", "county", "own"]
    months = records.groupBy(*key, "month").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    heads = cut_lineage(months.groupBy(*key).agg(F.min("first").alias("head"), F.sum("n").alias("n"), F.collect_set("month").alias("months")))
    # what no record has as its own key still links those that name it
    lists = records.filter(F.size("named") > 0).select(*key, F.explode("named").alias("name")).distinct()
    names = lists.join(heads.select(*key, "head"), key).select("load_id", "county", "name", "head")
    names = cut_lineage(names.unionByName(heads.select("load_id", "county", F.col("own").alias("name"), "head")))
    by_name = shared_name_edges(names, ["load_id", "county", "name"], "head")

    a, b = (tuple(f"{side}_{p}" for p in PARTS) for side in "ab")
    pairs = table(spark, sf_dir, "event_match_pairs").select("load_id", "event_key_a", "event_key_b")
    pairs = with_key_parts(with_key_parts(pairs, "event_key_a", a), "event_key_b", b).filter("a_county = b_county")
    pairs = pairs.select("load_id", F.col("a_county").alias("county"), *[x for s in "ab" for x in (F.concat_ws(":", f"{s}_source", f"{s}_source_id").alias(f"{s}_own"), F.col(f"{s}_month"))])
    pairs = cut_lineage(pairs.distinct())
    linked = pairs
    for side, end in (("a", "u"), ("b", "v")):
        # a key may stand in many pairs: their number decides whether it is split
        at = ["load_id", "county", f"{side}_own"]
        counts = pairs.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
        held = heads.select("load_id", "county", F.col("own").alias(f"{side}_own"), F.col("head").alias(end), F.col("months").alias("__months"))
        linked = skew_join(linked, held, at, "__n", [c for c in linked.columns if c not in at], "inner", counts)
        linked = linked.filter(F.array_contains("__months", F.col(f"{side}_month"))).drop("__months", f"{side}_own", f"{side}_month")

    groups = connected_groups(by_name.unionByName(linked.select("u", "v")))
    known = heads.join(groups.withColumnRenamed("vertex", "head"), "head", "left").filter("n > 1 or group_id is not null")
    known = cut_lineage(known.select(*key, "n", F.coalesce("group_id", "head").alias("group_id")))
    return skew_join(records.select("record_id", *key), known, key, "n", ["record_id"], "inner").select("record_id", "group_id")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group; one linked to no other is its own group."""
    records = table(spark, sf_dir, "extreme_events_county").select("record_id")
    return records.join(p4_found(spark, sf_dir), "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_documents(spark, sf_dir))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded and decoded again; null texts come back empty."""
    return decode_ids(p8_ids(spark, sf_dir))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(count_tokens(_documents(spark, sf_dir)), "doc_id", "n_tokens", CAPACITY)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = meet_candidates(_documents(spark, sf_dir), table(spark, sf_dir, "person_names"))
    return find_met(met, finder_of(met))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = meet_candidates(_documents(spark, sf_dir), table(spark, sf_dir, "person_names"), keep_text=True)
    return redact_met(met, finder_of(met))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p1_golden, p1_currency, p4_found, p4_groups, p8_ids, p8_decoded, p9_containers, p10_found, p10_redacted)}

_RECORDS = """
records AS (
  SELECT record_id, load_id, loaded_at, total_damage_amount, source_record_count, semantic_duplicate_count, associated_source_event_keys,
    CASE WHEN event_key IS NOT NULL THEN lower(trim(split_part(event_key, ':', 1))) ELSE lower(trim(event_source)) END AS source,
    CASE WHEN event_key IS NOT NULL THEN trim(split_part(event_key, ':', 2)) ELSE trim(source_event_id) END AS source_id,
    CASE WHEN event_key IS NOT NULL THEN lpad(trim(split_part(event_key, ':', 3)), 5, '0') ELSE lpad(trim(fips), 5, '0') END AS county,
    CASE WHEN event_key IS NOT NULL THEN substr(trim(split_part(event_key, ':', 4)), 1, 10) ELSE strftime(event_start_month, '%Y-%m-%d') END AS month
  FROM extreme_events_county
)"""

SQL = {
    "p1_found": f"""
WITH {_RECORDS}, sized AS (
  SELECT *, min(record_id) OVER g AS group_id, count(*) OVER g AS n FROM records WINDOW g AS (PARTITION BY load_id, source, source_id, county, month)
), cells AS (
  SELECT group_id, 'total_damage_amount' AS field_name, record_id, loaded_at, total_damage_amount AS v FROM sized WHERE n > 1
  UNION ALL SELECT group_id, 'source_record_count', record_id, loaded_at, CAST(source_record_count AS DOUBLE) FROM sized WHERE n > 1
  UNION ALL SELECT group_id, 'semantic_duplicate_count', record_id, loaded_at, CAST(semantic_duplicate_count AS DOUBLE) FROM sized WHERE n > 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY loaded_at DESC NULLS LAST, record_id) AS r
  FROM cells WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0
)
SELECT group_id, field_name, record_id FROM ranked WHERE r = 1""",
    "p4_found": f"""
WITH RECURSIVE {_RECORDS}, names AS (
  SELECT record_id, load_id, county, source || ':' || source_id AS k FROM records
  UNION
  SELECT record_id, load_id, county, regexp_replace(lower(x), '\\s+', '', 'g')
  FROM (SELECT record_id, load_id, county, unnest(regexp_split_to_array(associated_source_event_keys, '[|;,]')) AS x FROM records) WHERE trim(x) <> ''
), stars AS (SELECT record_id AS u, min(record_id) OVER (PARTITION BY load_id, county, k) AS v FROM names),
sides AS (
  SELECT load_id, lower(trim(split_part(event_key_a, ':', 1))) AS s1, trim(split_part(event_key_a, ':', 2)) AS i1, lpad(trim(split_part(event_key_a, ':', 3)), 5, '0') AS c1, substr(trim(split_part(event_key_a, ':', 4)), 1, 10) AS m1,
    lower(trim(split_part(event_key_b, ':', 1))) AS s2, trim(split_part(event_key_b, ':', 2)) AS i2, lpad(trim(split_part(event_key_b, ':', 3)), 5, '0') AS c2, substr(trim(split_part(event_key_b, ':', 4)), 1, 10) AS m2
  FROM event_match_pairs WHERE event_key_a IS NOT NULL AND event_key_b IS NOT NULL
), firsts AS (SELECT load_id, source, source_id, county, month, min(record_id) AS r FROM records GROUP BY ALL),
paired AS (
  SELECT a.r AS u, b.r AS v FROM sides s
  JOIN firsts a ON a.load_id = s.load_id AND a.source = s1 AND a.source_id = i1 AND a.county = c1 AND a.month = m1
  JOIN firsts b ON b.load_id = s.load_id AND b.source = s2 AND b.source_id = i2 AND b.county = c2 AND b.month = m2 WHERE c1 = c2
), edges AS MATERIALIZED (
  SELECT u, v FROM stars WHERE u <> v UNION SELECT v, u FROM stars WHERE u <> v
  UNION SELECT u, v FROM paired WHERE u <> v UNION SELECT v, u FROM paired WHERE u <> v
), reach(record_id, other) AS (
  SELECT DISTINCT u, u FROM edges
  UNION
  SELECT r.record_id, e.v FROM reach r JOIN edges e ON e.u = r.other
)
SELECT record_id, min(other) AS group_id FROM reach GROUP BY record_id""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
SQL["p1_survivors"] = SQL["p1_found"].replace("SELECT group_id, field_name, record_id FROM ranked", "SELECT group_id, field_name, record_id, v AS value, 'time' AS evidence FROM ranked")
SQL["p1_golden"] = SQL["p1_found"].replace(
    "SELECT group_id, field_name, record_id FROM ranked WHERE r = 1",
    "SELECT group_id, " + ", ".join(f"max(v) FILTER (field_name = '{f}') AS {f}" for f in SURVIVING_FIELDS) + " FROM ranked WHERE r = 1 GROUP BY 1",
)
SQL["p4_groups"] = SQL["p4_found"].replace(
    "SELECT record_id, min(other) AS group_id FROM reach GROUP BY record_id",
    ", found AS (SELECT record_id, min(other) AS group_id FROM reach GROUP BY record_id) SELECT e.record_id, coalesce(f.group_id, e.record_id) AS group_id FROM extreme_events_county e LEFT JOIN found f USING (record_id)",
)
