"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_tokens, bpe_words, fill_middle, flac, license_scan, line_dedup, main_text, ngram_join, packing, pq_dedup, resample, toxicity, url_filter
from .common import read, scratch, shared_folder, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed values of the URL query: action, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set sizes and components of documents that share at least 80 % of five-word shingles."""
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), words=5, percent=80)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their cleaned text, the number of lines and of dropped lines."""
    out = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


@query
def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's samples, read back from its stored FLAC stream, and of the stream."""
    found = flac.decode_media(scratch(flac.encode_media(read(spark, sf_dir, "documents")), "zstd"))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document, learned from the labels that aren't held out."""
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and how it came about."""
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels, and those the diagonals add."""
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] == "phrase")
    starts = F.transform(base, lambda s: s["first"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


@query
def op8_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of at least 0.95."""
    return pq_dedup.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.95)


@query
def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every text's ids and of what they decode to."""
    return bpe_words.word_round_trip(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op10_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the written files."""
    docs = read(spark, sf_dir, "documents")
    manifest = arrow_tokens.write_tokens(docs, shared_folder(spark), vocabulary("word_bpe_49k.json"), end_id=1)
    found = arrow_tokens.read_documents(spark, manifest, checksums=True)
    before = arrow_tokens.part_starts(manifest)
    return found.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


@query
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form and digests of every rearranged text and of the text rebuilt from it."""
    found = fill_middle.rearrange(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", F.col("prefix_chars").cast("long"), F.col("middle_chars").cast("long"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    return main_text.extract(read(spark, sf_dir, "pages"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, drawn towards the benchmark's texts."""
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL["op2_line_dedup"] = r"""
WITH d AS (SELECT doc_id, source, text FROM documents),
p AS (SELECT DISTINCT source, text, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL),
t AS (SELECT source, count(*) AS total FROM p GROUP BY source),
l AS (SELECT source, text, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM p),
c AS (SELECT source, line, count(*) AS pages FROM l WHERE line <> '' GROUP BY source, line),
b AS (SELECT c.source, list(c.line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages > 1 AND pages > 0.1 * total GROUP BY c.source),
j AS (SELECT d.*, string_split(d.text, chr(10)) AS lines, coalesce(b.bad, []) AS bad FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS kept, list_filter(lines, lambda x: list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS cut FROM j)
SELECT doc_id, source, CASE WHEN len(cut) > 0 THEN array_to_string(kept, chr(10)) ELSE text END AS text, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(cut), 0)::BIGINT AS n_dropped FROM k
"""

SQL["op6_url_filter"] = r"""
WITH RECURSIVE rules(rule, rule_host, rule_path, action) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
p AS (SELECT page_id, coalesce(url, '') AS url, html,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, CASE WHEN host <> '' THEN host || __PAGE_PATH__ || regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) END AS node FROM p),
tags AS (SELECT url, host, path, node, regexp_extract(unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?|''(?:[^''>]*\s)?)?canonical\b[^>]*>')), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM q
  UNION ALL SELECT url, host, path, node, regexp_extract(unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM q),
names AS (SELECT map_from_entries(list({'k': k, 'v': v})) AS named FROM (VALUES __NAMED__) AS n(k, v)),
coded AS (SELECT url, host, path, node, named, list_transform(regexp_extract_all(t, '&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&'), lambda p: {'p': p,
  'c': CASE WHEN regexp_matches(p, '^&#[0-9]+;$') THEN p[3:-2]::INT WHEN regexp_matches(p, '^&#[xX][0-9a-fA-F]+;$') THEN ('0x' || p[4:-2])::INT END}) AS ps FROM tags, names WHERE t <> ''),
told AS (SELECT url, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, node, array_to_string(list_transform(ps, lambda x: CASE WHEN x.c IS NULL THEN coalesce(named[x.p], x.p)
  WHEN x.c BETWEEN 1 AND 1114111 AND NOT x.c BETWEEN 55296 AND 57343 THEN chr(x.c) ELSE chr(65533) END), '') AS t FROM coded),
links AS (SELECT node, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '//') THEN 'x:' || t
  WHEN starts_with(t, '/') THEN 'x://' || host || t WHEN starts_with(t, '?') THEN 'x://' || host || path || t WHEN starts_with(t, '#') THEN 'x://' || host || path || regexp_extract(url, '://[^?#]*(\?[^#]*)', 1)
  ELSE 'x://' || host || regexp_replace(path, '[^/]*$', '') || t END AS t FROM told),
split AS (SELECT node AS a, translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(t, '://[^/?#]*([^?#]*)', 1) AS pt, regexp_extract(t, '://[^?#]*(\?[^#]*)', 1) AS qr FROM links WHERE t IS NOT NULL),
e AS (SELECT a, h || __SPLIT_PATH__ || qr AS b FROM split WHERE a IS NOT NULL AND h <> ''),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
every AS (SELECT node FROM q WHERE node IS NOT NULL UNION SELECT a FROM both_ways),
own AS (SELECT node, regexp_extract(node, '^([^/?]*)', 1) AS host, regexp_extract(node, '^[^/?]*([^?]*)', 1) AS path FROM every),
nodes AS (SELECT node, host, path FROM q WHERE node IS NOT NULL UNION SELECT node, host, path FROM own),
fits AS (SELECT node, path, rule, action, row_number() OVER (PARTITION BY node, path ORDER BY length(rule) DESC, action = 'allow' DESC, rule DESC) AS n FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
ruled AS (SELECT node, path, rule, action FROM fits WHERE n = 1),
same AS (SELECT node, action AS same FROM ruled JOIN own USING (node, path)),
passed AS (SELECT r.a AS node, CASE WHEN bool_or(same = 'block') AND NOT bool_or(same = 'allow') THEN 'block' ELSE 'allow' END AS verdict FROM reach r JOIN same ON same.node = r.b GROUP BY r.a)
SELECT page_id, q.host, q.path, rule, coalesce(action, same, passed.verdict, 'allow') AS verdict,
  CASE WHEN action IS NOT NULL THEN 'rule' WHEN coalesce(same, passed.verdict) IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM q LEFT JOIN ruled ON ruled.node = q.node AND ruled.path = q.path LEFT JOIN same ON same.node = q.node LEFT JOIN passed ON passed.node = q.node
"""

def _plain_path(path: str) -> str:
    """SQL for a path without . and .. steps; the empty path is /."""
    steps = f"string_split({path}, '/') || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN [''] ELSE [] END"
    return f"(CASE WHEN {path} = '' THEN '/' WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN array_to_string(list_reduce(list_prepend(['']::VARCHAR[], list_transform(({steps})[2:], lambda x: [x])), lambda a, b: CASE WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END), '/') ELSE {path} END)"


_NAMES = ", ".join("('{}', '{}')".format(name, to.replace("'", "''")) for name, to in url_filter.NAMED.items())
SQL["op6_url_filter"] = SQL["op6_url_filter"].replace("__NAMED__", _NAMES).replace("__SPLIT_PATH__", _plain_path("pt")).replace("__PAGE_PATH__", _plain_path("path"))

_TEMPLATES = ", ".join(f"({i}, '{label}', '{kind}', {k}, '{words}')" for i, (label, words, kind, k) in enumerate([(*p, "phrase", license_scan.PHRASE_GRAM) for p in license_scan.PHRASES] + [(*t, "text", license_scan.TEXT_GRAM) for t in license_scan.TEXTS]))
SQL["op7_license_scan"] = rf"""
WITH t(template, label, kind, k, body) AS (VALUES {_TEMPLATES}),
tw AS (SELECT template, label, kind, k, string_split(body, ' ') AS w FROM t),
tg AS (SELECT template, label, kind, k, len(w) - k + 1 AS t_grams, i - 1 AS t_pos, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tw)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dp AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dg AS (SELECT r, 2 AS k, i - 1 AS pos, array_to_string(w[i:i + 1], ' ') AS gram FROM dp WHERE i + 1 <= len(w) UNION ALL SELECT r, 3, i - 1, array_to_string(w[i:i + 2], ' ') FROM dp WHERE i + 2 <= len(w)),
hits AS (SELECT r, template, label, kind, t_grams, t_pos, pos, pos - t_pos AS diagonal, dg.k FROM dg JOIN tg ON dg.k = tg.k AND dg.gram = tg.gram),
marks AS (SELECT *, CASE WHEN kind = 'text' AND diagonal - lag(diagonal) OVER x <= 3 THEN 0 WHEN diagonal = lag(diagonal) OVER x THEN 0 ELSE 1 END AS new FROM hits WINDOW x AS (PARTITION BY r, template ORDER BY diagonal, pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS cluster FROM marks),
spans AS (SELECT r, label, kind, min(pos) AS first, count(DISTINCT t_pos) / max(t_grams) AS cover FROM runs GROUP BY r, template, label, kind, cluster),
good AS (SELECT * FROM spans WHERE (kind = 'phrase' AND cover = 1) OR (kind = 'text' AND cover >= 0.6)),
per AS (SELECT r, count(*) FILTER (kind = 'phrase') AS n_base, min(first) FILTER (kind = 'phrase') AS first_word, max(first) FILTER (kind = 'phrase') AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'phrase') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM good GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per USING (r)
"""

SQL["op11_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

SQL["op13_importance_resampling"] = r"""
WITH rule AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT side, r, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
n AS (SELECT side, r, f, count(*) AS n FROM f GROUP BY side, r, f),
kinds AS (SELECT f, hex(f) AS h FROM n GROUP BY f),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM kinds, rule),
b AS (SELECT side, r, bucket, sum(n) AS n FROM n JOIN hashed USING (f) GROUP BY side, r, bucket),
totals AS (SELECT coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t_all FROM b),
per AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM b GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM per, totals),
weight AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM b JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT w.r, w.doc_id, len(w.w) AS words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM w LEFT JOIN weight ON weight.r = w.r WHERE side = 0),
placed AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER () AS docs FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= docs * 25 // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""
