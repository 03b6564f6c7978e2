"""User transforms over surveys of any length."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators.guards import GuardError
from tracewright.operators.ordered import Series, indexed
from tracewright.operators.plugins import user_transform


def table(spark, sizes, holes=1):
    rows = [(s, i * holes, float((i * 7) % 11) if i % 5 else None, "x") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "survey_id string, sample_idx long, value double, core string")


def smoother():
    """Made here, so that workers needn't import this module."""

    def smoothed(rows, ctx):
        out = rows[["sample_idx"]].copy()
        out["smooth"] = rows["value"].rolling(5, center=True, min_periods=1).mean() * ctx["scale"]
        out["line"] = ctx["line_id"]
        return out

    return smoothed


smoothed = smoother()

SCHEMA = "sample_idx long, smooth double, line string"


def contexts(spark, names):
    return spark.createDataFrame([(n, "L" + n, 2.0) for n in names], "survey_id string, line_id string, scale double")


@pytest.mark.parametrize("chunk, holes", [(1 << 16, 1), (16, 1), (7, 3)])
def test_chunks_give_what_whole_surveys_give(spark, chunk, holes):
    sizes = {"a": 1, "b": 40, "c": 333}
    df = table(spark, sizes, holes).repartition(3)
    got = user_transform(indexed(df, ["survey_id"], "sample_idx", chunk_rows=chunk), smoothed, SCHEMA, contexts(spark, sizes), reach=(2, 2))
    assert got.columns == ["survey_id", "sample_idx", "smooth", "line"]
    got = got.toPandas().sort_values(["survey_id", "sample_idx"]).reset_index(drop=True)
    want = []
    for s, part in table(spark, sizes, holes).toPandas().groupby("survey_id"):
        out = smoothed(part, {"scale": 2.0, "line_id": "L" + s})
        out.insert(0, "survey_id", s)
        want.append(out)
    pd.testing.assert_frame_equal(got, pd.concat(want).reset_index(drop=True))


def test_a_hot_survey_spreads_over_chunks(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("survey_id"), F.col("id").alias("sample_idx"), F.lit(1.0).alias("value"))
    series = Series(df, ("survey_id",), "sample_idx", chunk_rows=5000, dense=True)

    def sized(rows, ctx):
        assert len(rows) <= 5000 + 4
        return rows.assign(n=len(rows))

    got = user_transform(series, sized, "sample_idx long, n long", reach=(2, 2))
    assert got.count() == 200_000 and got.agg(F.sum("sample_idx")).first()[0] == 200_000 * 199_999 // 2
    with pytest.raises(GuardError, match="reach"):
        user_transform(series, sized, "sample_idx long, n long", max_rows=199_999)


def test_a_whole_survey_may_return_any_rows(spark):
    df = table(spark, {"a": 3, "b": 5})
    seen = lambda rows, ctx: pd.DataFrame({"n": [len(rows), int(rows["sample_idx"].is_monotonic_increasing)], "who": [ctx["survey_id"]] * 2})
    got = user_transform(indexed(df.orderBy(F.desc("sample_idx")), ["survey_id"], "sample_idx"), seen, "n long, who string")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "a"), ("a", 3, "a"), ("b", 1, "b"), ("b", 5, "b")]
    none = user_transform(indexed(df.limit(0), ["survey_id"], "sample_idx"), seen, "n long, who string")
    assert none.collect() == []


def test_what_stops_the_job(spark):
    df = table(spark, {"a": 12, "b": 5})
    series = indexed(df, ["survey_id"], "sample_idx", chunk_rows=4)

    class Fitted:
        def fit(self, rows):
            return self

        def __call__(self, rows, ctx):
            return rows

    with pytest.raises(GuardError, match="fitted"):
        user_transform(series, Fitted(), SCHEMA)
    with pytest.raises(GuardError, match="index column"):
        user_transform(series, smoothed, "smooth double", reach=(1, 1))
    with pytest.raises(GuardError, match="keys are added"):
        user_transform(series, smoothed, "survey_id string, smooth double")
    with pytest.raises(GuardError, match="repeated keys"):
        user_transform(series, smoothed, SCHEMA, contexts(spark, ["a", "b", "b"]))
    with pytest.raises(Exception, match="no context for"):
        user_transform(series, smoothed, SCHEMA, contexts(spark, ["a"])).collect()
    for broken in (lambda r, c: r.iloc[1:], lambda r, c: r.assign(sample_idx=r["sample_idx"] + 1), lambda r, c: pd.concat([r, r])):
        with pytest.raises(Exception, match="each index of"):
            user_transform(series, broken, "sample_idx long, value double", reach=(1, 1)).collect()
    with pytest.raises(Exception, match="left out"):
        user_transform(series, lambda r, c: r[["sample_idx"]], "sample_idx long, y double", reach=(1, 1)).collect()


def test_short_surveys_share_a_batch_but_no_call(spark):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 500).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    seen = lambda rows, ctx: pd.DataFrame({"n": [len(rows)], "total": [rows["v"].sum()], "own": [ctx["k"]]})
    got = user_transform(indexed(rows, ["k"], "i"), seen, "n long, total double, own string")
    assert "MapInPandas" in got._jdf.queryExecution().executedPlan().toString()
    want = {f"s{j}": (6, float(sum(range(j, 3000, 500))), f"s{j}") for j in range(500)}
    assert {r.k: (r.n, r.total, r.own) for r in got.collect()} == want
    # whole numbers with nulls elsewhere keep their type: every survey has its own frame
    mixed = rows.withColumn("q", F.when(F.col("k") != "s1", F.col("i")))
    kind = lambda rows, ctx: pd.DataFrame({"kind": [str(rows["q"].dtype)]})
    kinds = {r.k: r.kind for r in user_transform(indexed(mixed, ["k"], "i"), kind, "kind string").collect()}
    assert kinds["s0"] == "int64" and kinds["s1"] != "int64"
