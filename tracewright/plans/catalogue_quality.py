"""Queries of the data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality as dq
from ..operators.identity import content_hashes
from ..operators.ordered import indexed
from ..session import cut
from ..sources.files import schema_problems
from . import views as v
from .catalogue import SQL, query
from .sql_views import FIX, HEADS, R, q, r6
from .views import r6 as rnd


def _out(df, key="survey_id", digits=6):
    return df.select(key, F.col("n_affected").cast("long").alias("n_affected"), rnd(F.col("value").cast("double"), digits).alias("value"), "failed")


#: The columns and types that whoever reads these tables relies on; three differ from what the files hold.
CONTRACTS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, session_id bigint",
    "lineitem": "l_orderkey bigint, l_linenumber bigint, l_quantity double, l_shipdate timestamp_ntz, l_returnflag string",
    "orders": "o_orderkey bigint, o_totalprice double, o_orderdate date, o_orderstatus string",
}
_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
_WANT = ", ".join(f"('{t}', '{c.split()[0]}', '{_DUCK[c.split()[1]]}')" for t, told in CONTRACTS.items() for c in told.split(", "))
_HAVE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type FROM (DESCRIBE {t})" for t in CONTRACTS)


@query(f"""
WITH want(table_name, column_name, kind) AS (VALUES {_WANT}), have AS ({_HAVE})
SELECT w.table_name, w.column_name, CASE WHEN h.column_name IS NULL THEN 'missing' ELSE 'wrong_type' END AS problem
FROM want w LEFT JOIN have h ON h.table_name = w.table_name AND h.column_name = w.column_name WHERE h.column_name IS NULL OR h.column_type <> w.kind""")
def dq_schema_types(spark, sf):
    found = []
    for name, told in CONTRACTS.items():
        wrong = schema_problems(spark, f"{sf}/{name}.parquet", T.StructType.fromDDL(told))
        each = F.array(*[F.struct(F.col(p).alias("columns"), F.lit(p).alias("problem")) for p in ("missing", "wrong_type")])
        rows = wrong.select(F.inline(each)).select(F.lit(name).alias("table_name"), F.explode("columns").alias("column_name"), "problem")
        found.append(rows)
    return reduce(DataFrame.unionByName, found).distinct()


def _rules():
    return {
        "value_range": ~F.col("value").between(0.5, 150.0),
        "type_category": ~F.col("event_type").isin("view", "click", "purchase", "error"),
        "chainage_negative": F.col("chainage_m") < 0,
    }


@query(q(R, """
, b AS (SELECT survey_id, CAST(value NOT BETWEEN 0.5 AND 150.0 AS INT) AS a, CAST(event_type NOT IN ('view', 'click', 'purchase', 'error') AS INT) AS b, CAST(chainage_m < 0 AS INT) AS c FROM r)
SELECT survey_id, sum(CASE WHEN a + b + c > 0 THEN 1 ELSE 0 END)::BIGINT AS n_affected, sum(a + b + c)::DOUBLE AS value, sum(a + b + c) > 0 AS failed FROM b GROUP BY 1"""))
def dq_contract(spark, sf):
    return _out(dq.contract(v.reading_rows(spark, sf), "survey_id", _rules()))


@query(q(R, """
SELECT event_id, 'value_range' AS rule FROM r WHERE value NOT BETWEEN 0.5 AND 150.0 UNION ALL
SELECT event_id, 'type_category' FROM r WHERE event_type NOT IN ('view', 'click', 'purchase', 'error') UNION ALL SELECT event_id, 'chainage_negative' FROM r WHERE chainage_m < 0"""))
def dq_failure_cases(spark, sf):
    return dq.failure_cases(v.reading_rows(spark, sf), ["event_id"], _rules())


@query(q(HEADS, """
SELECT survey_id, count(*) FILTER (WHERE b_lo < 1 OR b_lo > 150 OR b_hi < 1 OR b_hi > 150) AS n_affected,
  count(*) FILTER (WHERE b_lo < 1 OR b_lo > 150 OR b_hi < 1 OR b_hi > 150)::DOUBLE AS value, count(*) FILTER (WHERE b_lo < 1 OR b_lo > 150 OR b_hi < 1 OR b_hi > 150) > 0 AS failed FROM h GROUP BY 1"""))
def dq_range(spark, sf):
    return _out(dq.value_range(v.heads(v.reading_rows(spark, sf)), "survey_id", ["b_lo", "b_hi"], 1.0, 150.0))


@query(q(R, """
, u AS (SELECT survey_id, sample_idx, 'bucket' AS head, floor(value / 25)::VARCHAR AS x FROM r UNION ALL SELECT survey_id, sample_idx, 'event_type', event_type FROM r),
c AS (SELECT *, CASE WHEN lag(x) OVER w IS DISTINCT FROM x THEN 1 ELSE 0 END AS ch FROM u WINDOW w AS (PARTITION BY survey_id, head ORDER BY sample_idx)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY survey_id, head ORDER BY sample_idx) AS grp FROM c),
n AS (SELECT survey_id, head, grp, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT survey_id, coalesce(sum(CASE WHEN n >= 3 THEN n END), 0)::BIGINT AS n_affected, count(DISTINCT CASE WHEN n >= 3 THEN head END)::DOUBLE AS value,
       coalesce(sum(CASE WHEN n >= 3 THEN n END), 0) > 0 AS failed FROM n GROUP BY 1"""))
def dq_saturation_runs(spark, sf):
    s = v.readings(spark, sf)
    s = s.with_df(s.df.withColumn("bucket", F.floor(F.col("value") / 25).cast("string")))
    return _out(dq.saturation(s, "survey_id", ["bucket", "event_type"], 3))


@query("""
WITH o AS (SELECT l_suppkey, l_orderkey, lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY file_row_number) AS p
           FROM (SELECT *, row_number() OVER () AS file_row_number FROM lineitem))
SELECT l_suppkey, count(*) FILTER (WHERE l_orderkey - p <= 0) AS n_affected, count(*) FILTER (WHERE l_orderkey - p <= 0)::DOUBLE AS value,
       count(*) FILTER (WHERE l_orderkey - p <= 0) > 0 AS failed FROM o GROUP BY 1""")
def dq_monotonic(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", F.col("_metadata.row_index").alias("file_pos"))
    return _out(dq.monotonic(indexed(rows, ["l_suppkey"], "file_pos"), "l_suppkey", "l_orderkey"), "l_suppkey")


@query("""
WITH k AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
g AS (SELECT l_suppkey, l_orderkey - lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS gap FROM k)
SELECT l_suppkey, count(*) FILTER (WHERE gap > 80) AS n_affected, coalesce(sum((gap - 1) * 0.5) FILTER (WHERE gap > 80), 0)::DOUBLE AS value, count(*) FILTER (WHERE gap > 80) > 0 AS failed
FROM g GROUP BY 1""")
def dq_gap(spark, sf):
    rows = v.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
    return _out(dq.index_gaps(indexed(rows, ["l_suppkey"], "l_orderkey"), "l_suppkey", 0.5, 40.0), "l_suppkey")


@query("""
SELECT l_suppkey, sum(n - 1)::BIGINT AS n_affected, sum(n - 1)::DOUBLE AS value, sum(n - 1) > 0 AS failed
FROM (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def dq_duplicate_key(spark, sf):
    return _out(dq.duplicate_index(v.table(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey"]), "l_suppkey")


@query("""
WITH t AS (SELECT doc_id, sha256(text) AS h FROM documents), g AS (SELECT h, count(*) AS n, min(doc_id) AS first_survey FROM t GROUP BY 1)
SELECT t.doc_id, g.first_survey, g.n - 1 AS n_affected, g.n > 1 AS failed FROM t JOIN g USING (h)""")
def dq_duplicate_content(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return dq.duplicate_content(docs, "doc_id", "h").select("doc_id", "first_survey", "n_affected", "failed")


_OVERLAP = """
, e AS (SELECT line_id, survey_id, min(chainage_m) AS a, max(chainage_m) AS b, (max(chainage_m) - min(chainage_m)) / greatest(1, count(*) - 1) AS step FROM r GROUP BY 1, 2),
p AS (SELECT x.line_id, x.survey_id AS a, y.survey_id AS b, greatest(x.a, y.a) AS lo, least(x.b, y.b) AS hi, x.step FROM e x JOIN e y
      ON x.line_id = y.line_id AND x.survey_id < y.survey_id AND greatest(x.a, y.a) < least(x.b, y.b)),
c AS (SELECT p.a, p.b, corr(m.value, t.value) AS r, count(*) AS n FROM p JOIN r m ON m.survey_id = p.a JOIN r t ON t.survey_id = p.b AND t.sample_idx = m.sample_idx
      WHERE m.sample_idx BETWEEN trunc(p.lo / p.step) AND trunc(p.hi / p.step) GROUP BY 1, 2 HAVING count(*) >= 10)"""


def _overlaps(spark, sf):
    return _overlaps_of(v.readings(spark, sf))


def _overlaps_of(s):
    n = F.count(F.lit(1))
    ext = s.df.groupBy("line_id", "survey_id").agg(
        F.min("chainage_m").alias("start_m"), F.max("chainage_m").alias("end_m"),
        ((F.max("chainage_m") - F.min("chainage_m")) / F.greatest(F.lit(1), n - 1)).alias("step_m"),
    )
    return dq.overlap_correlation(s.df, ext, "line_id", "survey_id", "sample_idx", "value"), ext


@query(q(R, _OVERLAP + f" SELECT a, b, n, {r6('r')} AS r FROM c"))
def dq_overlap_correlation(spark, sf):
    return _overlaps(spark, sf)[0].select("a", "b", "n", rnd("r").alias("r"))


@query(q(R, _OVERLAP + f""",
s AS (SELECT a AS survey_id, b AS other, r FROM c UNION ALL SELECT b, a, r FROM c), w AS (SELECT survey_id, max(abs(r)) AS value FROM s GROUP BY 1)
SELECT e.survey_id, CAST(coalesce(w.value > 0.5, false) AS BIGINT) AS n_affected, {r6('coalesce(w.value, 0)')} AS value, coalesce(w.value > 0.5, false) AS failed FROM e LEFT JOIN w USING (survey_id)"""))
def dq_survey_overlap(spark, sf):
    corr, ext = _overlaps(spark, sf)
    return _out(dq.overlap_check(corr, ext, "survey_id", 0.5))


_STEP = """
, x AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM f WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY survey_id ORDER BY sample_idx)),
d AS (SELECT *, 2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2))))) AS step FROM x)"""


@query(q(FIX, _STEP + f""" SELECT survey_id, count(*) FILTER (WHERE step > 12) AS n_affected, {r6('coalesce(max(step), 0)', 4)} AS value, count(*) FILTER (WHERE step > 12) > 0 AS failed FROM d GROUP BY 1"""))
def dq_jump_distance(spark, sf):
    return _out(dq.jump_distance(v.fixes(v.readings(spark, sf)), "survey_id", "lat", "lon", 12.0), digits=4)


@query(q(FIX, _STEP + f""", p AS (SELECT survey_id, coalesce(sum(step), 0) AS path, max(chainage_m) - min(chainage_m) AS span FROM d GROUP BY 1),
z AS (SELECT survey_id, CASE WHEN span = 0 THEN 0 ELSE abs(path - span) / span END AS value FROM p)
SELECT survey_id, CAST(value > 0.02 AS BIGINT) AS n_affected, {r6('value', 5)} AS value, value > 0.02 AS failed FROM z"""))
def dq_path_vs_span(spark, sf):
    return _out(dq.path_vs_span(v.fixes(v.readings(spark, sf)), "survey_id", "lat", "lon", "chainage_m"), digits=5)


@query(q(HEADS, f"""
, x AS (SELECT survey_id, b_lo - lag(b_lo) OVER w AS d0, b_hi - lag(b_hi) OVER w AS d1 FROM h WINDOW w AS (PARTITION BY survey_id ORDER BY sample_idx)),
z AS (SELECT survey_id, stddev_pop(d0) / sqrt(2.0) AS s0, stddev_pop(d1) / sqrt(2.0) AS s1 FROM x GROUP BY 1),
n AS (SELECT *, CAST(coalesce(s0 < 15 OR s0 > 60, false) AS BIGINT) + CAST(coalesce(s1 < 15 OR s1 > 60, false) AS BIGINT) AS bad FROM z)
SELECT survey_id, bad AS n_affected, {r6('greatest(s0, s1)')} AS value, bad > 0 AS failed FROM n"""))
def dq_noise_floor(spark, sf):
    s = v.readings(spark, sf)
    return _out(dq.noise_floor(s.with_df(v.heads(s.df)), "survey_id", ["b_lo", "b_hi"], 15.0, 60.0))


@query(q(HEADS, f"""
, u AS (SELECT line_id, survey_id, 'b_lo' AS head, median(b_lo) AS med FROM h GROUP BY 1, 2 UNION ALL SELECT line_id, survey_id, 'b_hi', median(b_hi) FROM h GROUP BY 1, 2),
z AS (SELECT a.survey_id, a.head, abs(max(a.med) - avg(b.med)) / nullif(stddev_samp(b.med), 0) AS z, count(b.med) AS n FROM u a
      LEFT JOIN u b ON a.line_id = b.line_id AND a.head = b.head AND a.survey_id <> b.survey_id GROUP BY 1, 2)
SELECT survey_id, count(*) FILTER (WHERE n >= 2 AND z > 3) AS n_affected, {r6('max(CASE WHEN n >= 2 THEN z END)', 4)} AS value, count(*) FILTER (WHERE n >= 2 AND z > 3) > 0 AS failed FROM z GROUP BY 1"""))
def dq_regime_shift(spark, sf):
    s = v.readings(spark, sf)
    return _out(dq.regime_shift(v.heads(s.df), "line_id", "survey_id", ["b_lo", "b_hi"], longest=s.longest), digits=4)


@query(q(R, f"""
, m AS (SELECT survey_id, median(value) AS med, mad(value) AS mad FROM r GROUP BY 1),
z AS (SELECT r.survey_id, abs(0.6745 * (value - med) / CASE WHEN mad = 0 THEN 1e-9 ELSE mad END) > 5 AS out FROM r JOIN m USING (survey_id))
SELECT survey_id, count(*) FILTER (WHERE out) AS n_affected, {r6('avg(CAST(out AS INT))')} AS value, avg(CAST(out AS INT)) > 0.05 AS failed FROM z GROUP BY 1"""))
def dq_outlier_density(spark, sf):
    s = v.readings(spark, sf)
    return _out(dq.outlier_density(s.df, "survey_id", "value", longest=s.longest))


@query(q(R, f"""
, e AS (SELECT survey_id, min(run_id) AS run_id, (max(chainage_m) - min(chainage_m)) / 235.0 AS value FROM r GROUP BY 1)
SELECT survey_id, CAST(run_id > 0 AND value < 0.95 AS BIGINT) AS n_affected, CASE WHEN run_id > 0 THEN {r6('value')} END AS value, run_id > 0 AND value < 0.95 AS failed FROM e"""))
def dq_coverage(spark, sf):
    rows = v.reading_rows(spark, sf)
    return _out(dq.coverage(rows, _expected(rows), "survey_id", "chainage_m"))


def _expected(rows):
    """The length of every survey but a line's first runs, of which none is stated."""
    return rows.groupBy("survey_id").agg(F.min("run_id").alias("run_id")).filter("run_id > 0").select("survey_id", F.lit(235.0).alias("expected_length_m"))


_OWN_CHECKS = {
    "sample_idx_monotonic": q(R.replace("FROM events)", "FROM (SELECT *, row_number() OVER () AS file_pos FROM events))").replace("SELECT event_id,", "SELECT file_pos, event_id,", 1), """
, o AS (SELECT survey_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY survey_id ORDER BY file_pos) AS step FROM r) SELECT survey_id, count(*) FILTER (WHERE step <= 0) > 0 AS failed FROM o GROUP BY 1"""),
    "sample_idx_gap": q(R, """
, k AS (SELECT DISTINCT survey_id, CAST(floor(chainage_m) AS BIGINT) AS hour FROM r), g AS (SELECT survey_id, hour - lag(hour) OVER (PARTITION BY survey_id ORDER BY hour) AS gap FROM k)
SELECT survey_id, count(*) FILTER (WHERE gap > 24) > 0 AS failed FROM g GROUP BY 1"""),
    "duplicate_sample_idx": q(R, """
SELECT survey_id, sum(n - 1) > 0 AS failed FROM (SELECT survey_id, CAST(floor(chainage_m) AS BIGINT) AS hour, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1"""),
    "duplicate_content": q(R, """
, h AS (SELECT survey_id, string_agg(event_type || ' ' || value, ',' ORDER BY event_type, value) AS h FROM r GROUP BY 1) SELECT survey_id, count(*) OVER (PARTITION BY h) > 1 AS failed FROM h"""),
}
#: The registered query of every other check.
_QUERY_OF = {
    "schema": "dq_contract", "range": "dq_range", "saturation": "dq_saturation_runs", "survey_overlap": "dq_survey_overlap", "gps_jump": "dq_jump_distance",
    "gps_chainage_consistency": "dq_path_vs_span", "noise_floor": "dq_noise_floor", "background_regime": "dq_regime_shift", "interference_density": "dq_outlier_density", "coverage": "dq_coverage",
}
_ALL_CHECKS = " UNION ALL ".join(
    f"SELECT survey_id, CASE WHEN failed THEN '{dq.GATES[name]}' ELSE 'pass' END AS status FROM ({_OWN_CHECKS.get(name) or SQL[_QUERY_OF[name]]})" for name in dq.GATES
)


@query(f"""
SELECT survey_id, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn, count(*) FILTER (WHERE status = 'fail') AS n_fail,
       CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'quarantined' ELSE 'accepted' END AS verdict FROM ({_ALL_CHECKS}) GROUP BY 1""")
def dq_report_gate(spark, sf):
    """All fourteen checks of every survey, as one report, and its gate."""
    s = v.readings(spark, sf)
    s = s.with_df(cut(s.df))
    hours = F.floor("chainage_m").cast("long")
    in_file = v.reading_rows(spark, sf, F.col("_metadata.row_index").alias("file_pos"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    by_hour = s.df.select("survey_id", hours.alias("hour"))
    corr, ext = _overlaps_of(s)
    heads, fixed = s.with_df(v.heads(s.df)), v.fixes(s)
    sets = s.with_df(s.df.withColumn("bucket", F.floor(F.col("value") / 25).cast("string")))
    checks = {
        "schema": dq.contract(s.df, "survey_id", _rules()),
        "range": dq.value_range(heads.df, "survey_id", ["b_lo", "b_hi"], 1.0, 150.0),
        "saturation": dq.saturation(sets, "survey_id", ["bucket", "event_type"], 3),
        "sample_idx_monotonic": dq.monotonic(indexed(in_file, ["survey_id"], "file_pos"), "survey_id", "at_us"),
        "sample_idx_gap": dq.index_gaps(indexed(by_hour, ["survey_id"], "hour"), "survey_id", 1.0, 24.0),
        "duplicate_sample_idx": dq.duplicate_index(by_hour, "survey_id", ["hour"]),
        "duplicate_content": dq.duplicate_content(content_hashes(s.df, "survey_id", ["event_type", "value"]), "survey_id", "content_sha256"),
        "survey_overlap": dq.overlap_check(corr, ext, "survey_id", 0.5),
        "gps_jump": dq.jump_distance(fixed, "survey_id", "lat", "lon", 12.0),
        "gps_chainage_consistency": dq.path_vs_span(fixed, "survey_id", "lat", "lon", "chainage_m"),
        "noise_floor": dq.noise_floor(heads, "survey_id", ["b_lo", "b_hi"], 15.0, 60.0),
        "background_regime": dq.regime_shift(heads.df, "line_id", "survey_id", ["b_lo", "b_hi"], longest=s.longest),
        "interference_density": dq.outlier_density(s.df, "survey_id", "value", longest=s.longest),
        "coverage": dq.coverage(s.df, _expected(s.df), "survey_id", "chainage_m"),
    }
    return dq.gate(dq.report(checks, "survey_id"), "survey_id")


@query("""
WITH g AS (SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY 1, 2),
t AS (SELECT conv_id, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
a AS (SELECT conv_id, sum(n - 1)::BIGINT AS repeats FROM g GROUP BY 1), b AS (SELECT conv_id, count(*) FILTER (WHERE gap > 1) AS gaps FROM t GROUP BY 1)
SELECT conv_id, repeats, gaps FROM a JOIN b USING (conv_id)""")
def dq_turns(spark, sf):
    turns = v.table(spark, sf, "conversations").select("conv_id", "turn")
    repeats = dq.duplicate_index(turns, "conv_id", ["turn"]).select("conv_id", F.col("n_affected").alias("repeats"))
    gaps = dq.index_gaps(indexed(turns, ["conv_id"], "turn"), "conv_id", 1.0, 1.0).select("conv_id", F.col("n_affected").alias("gaps"))
    return repeats.join(gaps, "conv_id")
