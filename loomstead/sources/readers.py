"""Readers of provider formats into untyped DataFrames, and catalog look-ups."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.clean import clean_negatives
from loomstead.functions.text import raw_variable_column, table_name

CLIMDIV_MISSING = -99.99
#: State codes of the fifty states and the capital district.
STATE_CODES = (
    "01", "02", "04", "05", "06", "08", "09", "10", "11", "12", "13", "15", "16", "17", "18", "19", "20", "21", "22", "23", "24", "25", "26", "27", "28", "29",
    "30", "31", "32", "33", "34", "35", "36", "37", "38", "39", "40", "41", "42", "44", "45", "46", "47", "48", "49", "50", "51", "53", "54", "55", "56",
)


def read_csv_raw(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, clean: bool = True, rename_variables: bool = False, table: str = "") -> DataFrame:
    """Delimited files with a header as text columns, gzip and quoted line breaks included; malformed rows are skipped, measures below zero nulled.

    table is the name the rows are loaded under: some tables have measures of their own that may be below zero.
    """
    df = spark.read.csv(list(paths) if not isinstance(paths, str) else paths, header=True, inferSchema=False, mode="DROPMALFORMED", multiLine=True, enforceSchema=False)
    if columns:
        wanted = {c.lower() for c in columns}
        df = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns if c.lower() in wanted])
    if rename_variables:
        df = df.withColumnsRenamed({c: raw_variable_column(c) for c in df.columns})
    return clean_negatives(df, table) if clean else df


def union_csv_by_name(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Files with different headers in one table, absent columns null, with the file each row is from."""
    out = None
    for p in paths:
        df = read_csv_raw(spark, p, clean=False).withColumn("source_file", F.lit(Path(p).name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, inferSchema=False).columns


def read_feather(spark: SparkSession, path: str, nested_as_json: bool = False) -> DataFrame | None:
    """A Feather file, or None if there is none; nested columns as JSON text on demand."""
    if not Path(path).exists():
        return None
    from pyarrow import feather

    df = spark.createDataFrame(feather.read_table(path))
    if nested_as_json:
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes])
    return df


def load_registry(spark: SparkSession, folder: str, files: dict[str, str], globs: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The named files that exist, and every file a pattern finds under a name made from its own."""
    root = Path(folder)
    out = {name: read_csv_raw(spark, str(root / rel), rename_variables=True) for name, rel in files.items() if (root / rel).exists()}
    for pattern in globs:
        for p in sorted(root.glob(pattern)):
            out[table_name(p.name)] = read_csv_raw(spark, str(p))
    return out


def parse_climdiv(lines: DataFrame, parameter: str, first_year: int | None = None, last_year: int | None = None, line: str = "value") -> DataFrame:
    """(fips, parameter, year, month, value) of fixed-layout lines: a key of county code, element and year, then twelve values.

    -99.99 and blanks are missing. Lines that do not fit are left out.
    """
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.select(parts.alias("p")).filter((F.size("p") >= 2) & F.col("p")[0].rlike(r"^\d{9,}$"))
    rows = rows.select(F.substring(F.col("p")[0], 1, 5).alias("fips"), F.expr("right(p[0], 4)").cast("int").alias("year"), F.posexplode(F.slice("p", 2, 12)).alias("m", "text"))
    value = F.col("text").try_cast("double")
    rows = rows.select("fips", F.lit(parameter).alias("parameter"), "year", (F.col("m") + 1).alias("month"), F.when(value != CLIMDIV_MISSING, value).alias("value"))
    if first_year is not None:
        rows = rows.filter(F.col("year") >= first_year)
    return rows if last_year is None else rows.filter(F.col("year") <= last_year)


def read_json_pages(spark: SparkSession, pages: Sequence[str], schema: str) -> DataFrame:
    """Saved pages of a paged API, each a JSON array of records."""
    return spark.read.schema(schema).json(list(pages), multiLine=True)


def census_json(spark: SparkSession, path: str) -> DataFrame:
    """A survey API's array of arrays, the first being the header, as text columns."""
    import json

    rows = json.loads(Path(path).read_text())
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))


def unzip_member(archive: str, suffix: str) -> bytes:
    """The first member of a ZIP archive with a suffix."""
    with zipfile.ZipFile(io.BytesIO(Path(archive).read_bytes())) as z:
        names = [n for n in z.namelist() if n.lower().endswith(suffix.lower())]
        if not names:
            raise FileNotFoundError(f"no member ending in {suffix} in {archive}")
        return z.read(names[0])


def latest_versioned(index_html: str, pattern: str) -> str:
    """Of the links in an index page that match, the last in order of the numbers in them."""
    names = {m.group(0) for m in re.finditer(pattern, index_html)}
    if not names:
        raise LookupError(f"no file like {pattern}")
    return max(names, key=lambda n: ([int(x) for x in re.findall(r"\d+", n)], n))


def geojson_counties(spark: SparkSession, path: str) -> DataFrame:
    """County ids of a GeoJSON file: those of a state or the capital district that are no state totals."""
    raw = spark.read.option("wholetext", True).text(path)
    feats = raw.select(F.explode(F.from_json("value", "features array<struct<id:string, properties:map<string,string>>>")["features"]).alias("f"))
    fips = F.lpad(F.coalesce("f.id", F.try_element_at("f.properties", F.lit("GEOID"))), 5, "0").alias("fips")
    return feats.select(fips).filter(F.substring("fips", 1, 2).isin(*STATE_CODES) & ~F.col("fips").endswith("000")).distinct()


def read_dictionaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Variable dictionaries with the name of the file each row is from."""
    return spark.read.csv(pattern, header=True, inferSchema=False).withColumn("dictionary_file", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1))


def tables_like(spark: SparkSession, database: str, pattern: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database, pattern))


def columns_of(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table)] if spark.catalog.tableExists(table) else []


def new_rows_only(fresh: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the table does not have yet."""
    return fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti")
