"""The same views as SQL, for the side-by-side comparison."""

R = """
r0 AS (
  SELECT event_id, user_id AS line_id, CAST((day(ts) - 1) // 10 AS BIGINT) AS run_id, ts, event_type, value,
         concat(user_id, '_R', CAST((day(ts) - 1) // 10 AS BIGINT)) AS survey_id,
         (epoch_us(ts) - epoch_us(date_trunc('month', ts))) / 3.6e9 - ((day(ts) - 1) // 10) * 240.0 AS chainage_m
  FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY ts, event_id) - 1 AS sample_idx FROM r0)"""

FIX = R + """,
f AS (SELECT *, CASE WHEN event_type <> 'view' THEN 46.958 + chainage_m * 1e-5 + value * 1e-6 END AS lat,
             CASE WHEN event_type <> 'view' THEN 8.365 + chainage_m * 1e-5 END AS lon FROM r)"""

HEADS = R + """,
h AS (SELECT *, value AS b_lo, value + chainage_m * 0.05 AS b_mid, value * 0.5 + chainage_m * 0.1 AS b_hi FROM r)"""

IND = R + """,
isl AS (SELECT *, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY survey_id ORDER BY sample_idx) AS grp FROM r),
pk AS (
  SELECT survey_id, grp, min(line_id) AS line_id, min(run_id) AS run_id, min(chainage_m) AS start_m, max(chainage_m) AS end_m, count(*) AS n_rows,
         max(value) AS score, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS is_edge
  FROM isl WHERE value > 60 GROUP BY survey_id, grp),
pk2 AS (
  SELECT pk.survey_id, pk.grp, min(isl.sample_idx) AS peak_sample_idx
  FROM pk JOIN isl ON isl.survey_id = pk.survey_id AND isl.grp = pk.grp AND isl.value = pk.score WHERE isl.value > 60 GROUP BY 1, 2),
ind AS (
  SELECT pk.survey_id, pk.line_id, pk.run_id, pk.start_m AS chainage_start_m, pk.end_m AS chainage_end_m, pk.n_rows, pk.score AS anomaly_score,
         CASE WHEN is_edge = 1 THEN 'edge' ELSE 'clean' END AS dq_flag, pk2.peak_sample_idx, r.chainage_m AS chainage_peak_m, r.ts,
         substr(sha256(concat_ws('|', pk.survey_id, 'v1', pk2.peak_sample_idx, printf('%.3f', r.chainage_m))), 1, 24) AS indication_id
  FROM pk JOIN pk2 USING (survey_id, grp) JOIN r ON r.survey_id = pk.survey_id AND r.sample_idx = pk2.peak_sample_idx)"""

_SRC = """
ref AS (SELECT line_id, min(survey_id) AS survey_id FROM r GROUP BY line_id),
rr AS (SELECT r.* FROM r JOIN ref USING (line_id, survey_id)),
lab AS (
  SELECT *, k.kind, event_type = k.label AS hit,
         sum(CASE WHEN event_type = k.label THEN 0 ELSE 1 END) OVER (PARTITION BY survey_id, k.kind ORDER BY sample_idx) AS lgrp
  FROM rr CROSS JOIN (VALUES ('defect', 'error'), ('interference', 'signup')) AS k(kind, label)),
runs AS (
  SELECT line_id, survey_id, kind, lgrp, min(event_type) AS defect_type, avg(chainage_m) AS chainage_m, min(chainage_m) AS chainage_start_m,
         max(chainage_m) AS chainage_end_m, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx
  FROM lab WHERE hit GROUP BY 1, 2, 3, 4),
src AS (
  SELECT *, concat(line_id, '_', kind, '_', printf('%02d', row_number() OVER (PARTITION BY line_id, kind ORDER BY start_idx) - 1)) AS source_id
  FROM runs)"""

SRC = R + "," + _SRC
IND_SRC = IND + "," + _SRC

GREEDY = IND_SRC + """,
cand AS (
  SELECT i.survey_id, i.indication_id, s.source_id, s.kind, abs(i.chainage_peak_m - s.chainage_m) AS d
  FROM ind i JOIN src s ON s.line_id = i.line_id WHERE abs(i.chainage_peak_m - s.chainage_m) <= 15),
lists AS (SELECT survey_id, list({'l': indication_id, 'r': source_id} ORDER BY d, indication_id, source_id) AS ps FROM cand GROUP BY 1),
walked AS (
  SELECT survey_id, unnest(list_reduce(ps, lambda acc, x:
      CASE WHEN len(list_filter(acc, lambda t: t.l = x.l OR t.r = x.r)) > 0 THEN acc ELSE list_append(acc, x) END,
      CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]))) AS p FROM lists),
m AS (
  SELECT i.*, w.p.r AS matched_source_id, s.kind AS matched_kind, abs(i.chainage_peak_m - s.chainage_m) AS distance_m
  FROM ind i LEFT JOIN walked w ON w.survey_id = i.survey_id AND w.p.l = i.indication_id
  LEFT JOIN src s ON s.source_id = w.p.r)"""

L = """
l0 AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample_idx FROM lineitem),
l AS (SELECT *, date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) + sample_idx * CAST(0.001 AS DOUBLE) AS x, l_extendedprice / 1000.0 AS y FROM l0)"""

DOC = """
d AS (SELECT labels.doc_id, quality, toxic, n_chars, lang, source, n_chars / (n_chars + 2000.0) AS score FROM labels JOIN documents USING (doc_id))"""

REV = """
g AS (SELECT l_suppkey, CAST(year(l_shipdate) - 1995 AS BIGINT) AS run_id, sum(l_extendedprice * (1 - l_discount)) AS y_true FROM lineitem GROUP BY 1, 2)"""


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def q(views: str, body: str) -> str:
    return f"WITH {views.strip()}\n{body.strip()}"
