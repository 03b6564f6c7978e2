"""Files of any state: wrong types, no Parquet, too long for a row, arriving one by one."""

import hashlib
import json
import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_surveys import CFG, walk, write

from tracewright.operators import features as ft
from tracewright.plans import jobs
from tracewright.sources import files
from tracewright.sources import surveys as io
from tracewright.streaming import arrivals

SMALL = ft.FeatureConfig(windows_m=(2.0, 5.0), detrend_window_m=10.0)


def write_part(root, df, part):
    path = f"{root}/line_id={df['line_id'].iloc[0]}/run_id={df['run_id'].iloc[0]}"
    os.makedirs(path, exist_ok=True)
    out = df.drop(columns=["line_id", "run_id"])
    out.astype({c: "int64" for c in ("defect", "interference", "girth_weld", "sample_idx")}).to_parquet(f"{path}/{part}.parquet")
    return path


def test_wrong_files_stop_nothing(spark, tmp_path):
    root, store = str(tmp_path / "raw"), str(tmp_path / "store")
    write(root, walk(1, 0, "007", n=900))
    write_part(root, walk(2, 1, "007", n=300).assign(t_s=lambda d: d["t_s"].astype(str)).drop(columns=["lat"]), "survey")
    whole = write_part(root, walk(3, 2, "007", n=300), "a")
    (tmp_path / "raw" / "line_id=007" / "run_id=2" / "b.parquet").write_bytes(b"no parquet")
    rows, refused = io.scan_surveys(spark, root)
    assert [r["survey_id"] for r in rows.select("survey_id").distinct().collect()] == ["007_R0"] and rows.count() == 900
    bad = {r["survey_id"]: r for r in refused.collect()}
    assert sorted(bad) == ["007_R1", "007_R2"]
    told = json.loads(bad["007_R1"]["detail"])["files"]
    assert (told[0]["missing"], told[0]["wrong_type"], bad["007_R1"]["n_affected"]) == (["lat"], ["t_s"], 2)
    # the readable file of a refused survey isn't taken for the whole of it
    assert [f["path"].rsplit("/", 1)[1] for f in json.loads(bad["007_R2"]["detail"])["files"]] == ["b.parquet"] and os.path.exists(whole)

    got = {r["survey_id"]: r for r in jobs.full_run(spark, root, store, CFG, SMALL).collect()}
    assert {s: (r["outcome"], r["status"]) for s, r in got.items()} == {"007_R0": ("accepted", "accepted"), "007_R1": ("accepted", "quarantined"), "007_R2": ("accepted", "quarantined")}
    assert spark.read.parquet(f"{store}/features").count() == 900
    report = spark.read.parquet(f"{store}/dq_report").filter("survey_id = '007_R1'").collect()
    assert [(r["check_name"], r["status"], r["n_affected"]) for r in report] == [("schema", "fail", 2)]
    assert spark.read.text(f"{store}/quarantine/reports").select("survey_id").distinct().count() == 2
    # registered once
    again = {r["survey_id"]: r["outcome"] for r in jobs.full_run(spark, root, store, CFG, SMALL).collect()}
    assert set(again.values()) == {"noop"}


def test_one_bad_file_of_many_and_none_good(spark, tmp_path):
    root = str(tmp_path)
    for i in range(30):
        write_part(root, walk(1, i, "a b%", n=120), "survey")
    (tmp_path / "line_id=a b%" / "run_id=7" / "survey.parquet").write_bytes(b"PAR1")
    rows, refused = io.scan_surveys(spark, root)
    assert rows.select("survey_id").distinct().count() == 29 and [r["run_id"] for r in refused.collect()] == [7]
    only = str(tmp_path / "line_id=a b%" / "run_id=7")
    rows, refused = io.scan_surveys(spark, root, paths=[only])
    assert rows.count() == 0 and "survey_id" in rows.columns and refused.count() == 1
    os.makedirs(tmp_path / "other")
    pd.DataFrame({"x": [1]}).to_parquet(tmp_path / "other" / "x.parquet")
    _, refused = io.scan_surveys(spark, str(tmp_path / "other"))
    assert refused.first()["survey_id"].endswith("x.parquet")


def test_footer_types(spark, tmp_path):
    pd.DataFrame({"a": pd.Categorical(["x"]), "b": pd.Series([1], dtype="int32"), "c": [[1.0]], "d": pd.to_datetime(["2024-01-01"])}).to_parquet(tmp_path / "t.parquet")
    found = files.footer_schema(f"file:{tmp_path}/t.parquet")
    assert [f.dataType.simpleString() for f in found.fields] == ["string", "int", "array<double>", "timestamp_ntz"]


def test_a_long_file_is_hashed_in_little_memory(tmp_path):
    path = tmp_path / "sparse.bin"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    code = (
        "import resource, sys; from tracewright.sources.files import stream_sha256; digest = stream_sha256('file:' + sys.argv[1]);"
        "print(digest, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    digest, peak = subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, check=True, cwd=os.getcwd()).stdout.split()
    want, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range((3 << 30) >> 24):
        want.update(block)
    assert digest == want.hexdigest() and int(peak) < 300 * 1024


def test_a_survey_waits_for_its_files(spark, tmp_path):
    root, store, ck, told = (str(tmp_path / n) for n in ("raw", "store", "ck", "told"))
    whole = walk(5, 0, "007", n=900)
    write_part(root, whole.iloc[:500], "a")
    os.makedirs(told)
    (tmp_path / "told" / "1.json").write_text('{"line_id": "007", "run_id": 0, "n_files": 2}\n')
    arrivals.run(spark, root, store, ck, CFG, SMALL, manifest=told)
    assert files.committed(spark, f"{store}/registry") == [] and not os.path.exists(f"{store}/registry")
    assert arrivals.Waiting(spark, store).read().count() == 1
    # the second file arrives after the first run: registered once, whole
    write_part(root, whole.iloc[500:], "b")
    arrivals.run(spark, root, store, ck, CFG, SMALL, manifest=told)
    registry = spark.read.parquet(f"{store}/registry").collect()
    assert [(r["survey_id"], r["n_samples"], r["status"]) for r in registry] == [("007_R0", 900, "accepted")]
    feats = spark.read.parquet(f"{store}/features")
    assert feats.count() == 900 and feats.select("sample_idx").distinct().count() == 900
    assert arrivals.Waiting(spark, store).read().count() == 0
    # one more file is reported and changes nothing stored
    write_part(root, whole.iloc[:5].assign(sample_idx=range(900, 905)), "c")
    arrivals.run(spark, root, store, ck, CFG, SMALL, manifest=told)
    assert spark.read.parquet(f"{store}/registry").count() == 1 and spark.read.parquet(f"{store}/features").count() == 900
    assert arrivals.Waiting(spark, store).read().count() == 0


def test_without_a_manifest_a_survey_lies_quiet_first(spark, tmp_path):
    root = str(tmp_path / "raw")
    folder = write_part(root, walk(5, 0, "007", n=120), "a")
    waiting = spark.createDataFrame([(f"file:{folder}", "007", 0)], arrivals.WAITING)
    newest = os.path.getmtime(f"{folder}/a.parquet")
    assert arrivals.complete(spark, waiting, None, 60.0, newest + 59).count() == 0
    assert arrivals.complete(spark, waiting, None, 60.0, newest + 61).count() == 1


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    root, store, ck = (str(tmp_path / n) for n in ("raw", "store", "ck"))
    write_part(root, walk(0, 0, "007", n=600), "a")

    def killed(*args, **kw):
        jobs.full_run(*args, **kw)
        raise RuntimeError("killed")

    monkeypatch.setattr(arrivals, "full_run", killed)
    with pytest.raises(Exception, match="killed"):
        arrivals.run(spark, root, store, ck, CFG, SMALL)
    monkeypatch.undo()
    arrivals.run(spark, root, store, ck, CFG, SMALL)
    assert sorted(r["survey_id"] for r in spark.read.parquet(f"{store}/registry").collect()) == ["007_R0"]
    feats = spark.read.parquet(f"{store}/features")
    assert feats.count() == 600 and feats.select("sample_idx").distinct().count() == 600
    assert spark.read.parquet(f"{store}/dq_report").filter(F.col("check_name") == "schema").count() == 1
    assert arrivals.Waiting(spark, store).read().count() == 0
