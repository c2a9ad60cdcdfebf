"""Tables, lineage and bundles: full rebuilds, swaps, appends by name and JSON for pages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators.relational import assert_unique_key


def replace_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Write a table anew and read it; sort_by orders rows within files in place of an index, key is checked first."""
    spark = df.sparkSession
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name.split('.')[0]}`")
    if key:
        assert_unique_key(df, key)
    if sort_by:
        df = df.repartition(*[F.col(c) for c in sort_by[:1]]).sortWithinPartitions(*sort_by)
    w = df.write.mode("overwrite").format("parquet")
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)
    return spark.table(name)


def swap_table(df: DataFrame, name: str) -> DataFrame:
    """Replace a table by something made from it: written under another name first, then the two are renamed.

    The old table is dropped last. If the new one cannot take its name, the old one gets it back.
    """
    spark = df.sparkSession
    fresh, old = f"{name}__new", f"{name}__old"
    for leftover in (fresh, old):
        spark.sql(f"DROP TABLE IF EXISTS {leftover}")
    df.write.format("parquet").saveAsTable(fresh)
    replaced = spark.catalog.tableExists(name)
    if replaced:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    except Exception:
        if replaced:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    return spark.table(name)


def append_by_name(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    """Slices with different columns as one wide table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_metadata(spark: SparkSession, schema: str, table: str, df: DataFrame, path: str, url: str | None = None) -> DataFrame:
    """One row of lineage of a loaded file: its rows, columns and SHA-256."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    row = (schema, table, Path(path).name, str(Path(path).parent), path, df.count(), json.dumps(df.columns), url, h.hexdigest())
    cols = "table_schema string, table_name string, filename string, source_folder string, source_path string, row_count bigint, detected_columns string, upstream_source_url string, content_sha256 string"
    return spark.createDataFrame([row], cols).withColumn("loaded_at", F.current_timestamp())


def bundle_text(df: DataFrame, name: str) -> DataFrame:
    """(value): window.NAME=[...]; of the rows as compact JSON, NaN as null, '<' escaped; for page-sized results."""
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    rows = df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j"))
    body = rows.agg(F.array_join(F.array_sort(F.collect_list("j")), ",").alias("b"))
    return body.select(F.concat(F.lit(f"window.{name}=["), F.replace("b", F.lit("<"), F.lit("\\u003c")), F.lit("];")).alias("value"))


def write_bundle(df: DataFrame, name: str, path: str) -> str:
    """Write a bundle as one text file and return its fingerprint."""
    text = bundle_text(df, name).first()["value"]
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(text)
    part.replace(target)
    return fingerprint(text)


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]
