import hashlib
import json

from pyspark.sql import functions as F

from tracewright.sources import surveys as io
from tracewright.sources.files import file_hashes


def test_indications_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "ind")
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "indication_id string, x double")
    more = spark.createDataFrame([("b", 9.0), ("c", 3.0)], "indication_id string, x double")
    assert io.write_indications(spark, df, path) == 2
    assert io.write_indications(spark, df, path) == 0
    assert io.write_indications(spark, more, path) == 1
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_quarantine_holds_failed_surveys_only(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "survey_id string, x int")
    dq = spark.createDataFrame([("a", "range", "fail", 1, "{}"), ("b", "range", "pass", 0, "{}")], "survey_id string, check_name string, status string, n_affected int, detail string")
    verdicts = spark.createDataFrame([("a", "quarantined"), ("b", "accepted")], "survey_id string, verdict string")
    io.quarantine(rows, dq, verdicts, str(tmp_path))
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").select("survey_id", "x").collect()] == [("a", 1)]
    report = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/reports").collect()]
    assert [(r["check_name"], r["status"]) for r in report] == [("range", "fail")]


def test_geojson_skips_unlocated_rows(spark):
    df = spark.createDataFrame([("a", 46.0, 8.0, float("nan")), ("b", None, 8.0, 1.0)], "i string, lat double, lon double, risk double")
    got = [json.loads(r.value) for r in io.geojson(df, ["i", "risk"]).collect()]
    assert got == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [8.0, 46.0]}, "properties": {"i": "a", "risk": None}}]


def test_files_traces_and_ids(spark, tmp_path):
    raw = tmp_path / "t.csv"
    raw.write_text("# note\na,b\n1,2.5\n# more\n3,4.5\n")
    assert [tuple(r) for r in io.read_trace(spark, str(raw), "a int, b double").collect()] == [(1, 2.5), (3, 4.5)]
    assert file_hashes(spark, str(tmp_path)).first().file_sha256 == hashlib.sha256(raw.read_bytes()).hexdigest()
    ids = spark.createDataFrame([("A_R1", 7)], "l string, r long").select(io.survey_id(F.col("l"), F.col("r")).alias("s"))
    line, run = io.split_survey_id(F.col("s"))
    assert tuple(ids.select(line, run).first()) == ("A_R1", 7)


def test_files_are_keyed_through_the_registry(spark, tmp_path):
    for n in ("x", "y"):
        spark.createDataFrame([(1, float("nan")), (2, 2.0)], "i int, v double").coalesce(1).write.parquet(str(tmp_path / n))
    found = spark.read.parquet(str(tmp_path / "x"), str(tmp_path / "y")).select(F.col("_metadata.file_path").alias("source_uri")).distinct()
    registry = found.withColumn("survey_id", F.regexp_extract("source_uri", "/(x|y)/", 1))
    got = io.read_files(spark, [str(tmp_path / "x"), str(tmp_path / "y")], registry, ["i", "v"])
    assert sorted((r.survey_id, r.i, r.v) for r in got.collect() if r.v is not None) == [("x", 2, 2.0), ("y", 2, 2.0)]
    assert got.filter("v is null").count() == 2


def test_latest_row_and_slice(spark):
    df = spark.createDataFrame([("v1", 1, 0), ("v2", 2, 0), ("v2", 3, 1)], "pipeline_version string, t int, is_shadow int")
    assert io.latest_by(df, [], "t").first().pipeline_version == "v2"
    assert [r.t for r in io.published_slice(df, "v2").collect()] == [2]
