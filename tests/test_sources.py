"""Readers and sinks on small files."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomstead.sources import readers, sinks


def test_csv_skips_bad_rows_and_keeps_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("fips,total_amount,DP03_0062PE\n01001,-5,1.0\n01003,7,x,extra\n01005,8,2\n")
    got = {tuple(r) for r in readers.read_csv_raw(spark, str(p), rename_variables=True).collect()}
    assert got == {("01001", None, "1.0"), ("01005", "8", "2")}
    assert readers.csv_columns(spark, str(p)) == ["fips", "total_amount", "DP03_0062PE"]


def test_gzip_and_projection(spark, tmp_path):
    p = tmp_path / "s.csv.gz"
    p.write_bytes(gzip.compress(b"EVENT_ID,STATE,X\n1,AL,9\n"))
    df = readers.read_csv_raw(spark, [str(p)], ["event_id", "state"])
    assert df.columns == ["event_id", "state"] and df.count() == 1


def test_union_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    out = readers.union_csv_by_name(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {(r["x"], r["y"], r["z"], r["source_file"]) for r in out.collect()} == {("1", "2", None, "a.csv"), (None, "3", "4", "b.csv")}


def test_registry_and_dictionaries(spark, tmp_path):
    (tmp_path / "acs").mkdir()
    (tmp_path / "acs" / "Census ACS5-2020.csv").write_text("year,v\n2020,1\n")
    (tmp_path / "n.csv").write_text("a\n1\n")
    got = readers.load_registry(spark, str(tmp_path), {"n": "n.csv", "gone": "gone.csv"}, ["acs/*.csv"])
    assert set(got) == {"n", "census_acs5_2020"}
    assert readers.read_dictionaries(spark, str(tmp_path / "acs")).first()["dictionary_file"].endswith(".csv")


def test_climdiv(spark):
    line = "01001022020 " + " ".join(["1.5", "-99.99", *["2.0"] * 10])
    got = {r["month"]: r["value"] for r in readers.parse_climdiv(spark.createDataFrame([(line,), ("",), (None,)], "value string"), "tavg").collect()}
    assert got[1] == 1.5 and got[2] is None and len(got) == 12
    assert readers.parse_climdiv(spark.createDataFrame([(line,)], "value string"), "tavg", 2021).count() == 0


def test_feather(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    p = str(tmp_path / "a.feather")
    feather.write_feather(pa.table({"fips": ["01001"], "s": [{"a": [1, 2]}]}), p)
    assert readers.read_feather(spark, p, nested_as_json=True).first()["s"] == '{"a":[1,2]}'
    assert readers.read_feather(spark, str(tmp_path / "none.feather")) is None


def test_json_zip_index(spark, tmp_path):
    (tmp_path / "p1.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "p2.json").write_text('[{"id": 3}]')
    assert readers.read_json_pages(spark, [str(tmp_path / f"p{i}.json") for i in (1, 2)], "id long").count() == 3
    (tmp_path / "c.json").write_text('[["NAME","state"],["A","01"],[null,"02"]]')
    assert {tuple(r) for r in readers.census_json(spark, str(tmp_path / "c.json")).collect()} == {("A", "01"), (None, "02")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/x.CSV", "a\n1\n")
    assert readers.unzip_member(str(tmp_path / "z.zip"), ".csv") == b"a\n1\n"
    assert readers.latest_versioned('<a href="f-v1.0.0-20240105"> <a href="f-v1.0.0-20240210">', r"f-v[\d.]+-\d{8}") == "f-v1.0.0-20240210"


def test_geojson(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"features": [{"id": "01001", "properties": {}}, {"id": "01000", "properties": {}}, {"properties": {"GEOID": "72001"}}, {"properties": {"GEOID": "6037"}}]}))
    assert {r[0] for r in readers.geojson_counties(spark, str(p)).collect()} == {"01001", "06037"}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    t = sinks.replace_table(df, "mart.t", key=["k"], sort_by=["k"])
    assert t.count() == 2
    assert sinks.swap_table(t.filter("k = 1"), "mart.t").count() == 1
    assert "t" in readers.tables_like(spark, "mart", "t*") and readers.columns_of(spark, "mart.t") == ["k", "v"] and readers.columns_of(spark, "mart.none") == []
    with pytest.raises(ValueError):
        sinks.replace_table(df.union(df), "mart.u", key=["k"])
    assert readers.new_rows_only(df, spark.table("mart.t"), ["k"]).first()["k"] == 2
    wide = sinks.append_by_name(spark, [df, df.select("k", F.lit(1).alias("w"))])
    assert wide.columns == ["k", "v", "w"] and wide.count() == 4
    f = tmp_path / "x.csv"
    f.write_text("a\n1\n")
    assert sinks.file_metadata(spark, "raw", "x", df, str(f)).first()["row_count"] == 2


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "<b>")], "k int, x double, s string")
    p = tmp_path / "b.js"
    mark = sinks.write_bundle(df, "DATA", str(p))
    assert p.read_text() == 'window.DATA=[{"k":1,"x":null,"s":"\\u003cb>"}];' and mark == sinks.fingerprint(p.read_text())
