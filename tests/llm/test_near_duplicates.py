"""Links and components of texts and vectors against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import ngram_join, pq_dedup, shingles, stages


def united(names, links):
    least = {n: n for n in names}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def family(rng, size, members, rate):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    return [" ".join(w if rng.random() > r else f"x{rng.randrange(10**6)}" for w in base) for r in (rng.random() * rate for _ in range(members))]


def corpus():
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(rng, 150, 90, 0.06) + family(rng, 20, 60, 0.08) + family(rng, 400, 30, 0.03)
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) for _ in range(40)]
    texts += [texts[3]] * 25 + ["one two", "ONE  two", "one two three", "", None, " \t\n", "É é É é É é", "é é é é é é", " ".join(f"long{i}" for i in range(30_000))] * 2
    return texts


def brute(texts):
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in sets for j in range(i) if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 5 >= 4 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, united(sets, links)


@pytest.mark.parametrize("list_rows", [32, 4])
def test_ngram_components_are_those_of_all_pairs(spark, monkeypatch, list_rows):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", list_rows)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in enumerate(texts)], "doc_id long, text string, token long, set_id string").repartition(3)
    sets, least = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in sets}


def test_ngram_join_of_nothing_and_of_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert ngram_join.ngram_components(spark.createDataFrame([], schema)).count() == 0
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (2, text), (None, text), (9, ""), (10, None), (11, "alone but long enough to stay")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.ngram_components(docs).collect())
    assert got == [(0, 2), (2, 2), (5, 2), (5, 2), (9, 9), (10, 10), (11, 11)]
    kept = stages.near_dup_stage(spark, docs.unionByName(docs.where("doc_id = 11")), "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 9, 10, 11]


def test_shingles_don_t_depend_on_the_block():
    texts = [t or "" for t in corpus()[:60]] + ["", "a", "\ud800 b c d e f"]
    whole = list(shingles.shingle_sets(texts))
    assert all((a == b).all() and len(a) == len(shingle_set(t)) for t, a in zip(texts, whole) for b in shingles.shingle_sets([t]))


def vectors():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [c + 0.12 * rng.normal(size=16) for c in centre for _ in range(40)] + list(rng.normal(size=(200, 16)))
    rows += [rows[0]] * 30 + [rows[1] * 3.0, -rows[1], np.zeros(16), np.full(16, np.nan), np.r_[np.inf, np.zeros(15)], np.ones(3), None, [1.0] * 15 + [None]]
    return rows


@pytest.mark.parametrize("sizes", [(2048, 4096), (16, 24)])
def test_vectors_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(pq_dedup, "MEMBERS", sizes[0])
    monkeypatch.setattr(pq_dedup, "VISITORS", sizes[1])
    monkeypatch.setattr(pq_dedup, "LIST_SIZE", 30)
    rows = [None if v is None else [None if x is None else float(x) for x in v] for v in vectors()]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, list int, class string")
    got = {r["vec_id"]: r for r in pq_dedup.near_vectors(table).collect()}
    good = [i for i, v in enumerate(rows) if v is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    pairs, links = [], {}
    for width in {len(rows[i]) for i in good}:
        own = [i for i in good if len(rows[i]) == width]
        x = np.array([rows[i] for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        pairs += [(own[a], own[b]) for a, b in zip(*np.nonzero(np.triu(near)))]
        links |= dict(zip(own, near.sum(axis=1).tolist()))
    least = united(range(len(rows)), pairs)
    found = sum(got[i]["n_links"] for i in good) / max(1, sum(links.values()))
    assert len(got) == len(rows) and 0.99 <= found <= 1
    assert all(got[i]["n_links"] == links.get(i, 0) and got[i]["component_id"] == least[i] and got[i]["kept"] == (least[i] == i) for i in range(len(rows)))


def test_every_length_links_among_itself(spark):
    rows = [[1.0, 0.0, 0.0, float(i)] for i in range(6)] + [[1.0, 0.0], [1.0, 0.001], [-0.0, 2.0], [0.0, 1.0]]
    table = spark.createDataFrame(list(enumerate(rows)) + [(9, rows[9])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pq_dedup.near_vectors(table).collect() if r["vec_id"] >= 6)
    assert got == [(6, 1, 6), (7, 1, 6), (8, 2, 8), (9, 2, 8), (9, 2, 8)]


def planted_pairs(n, width=64):
    """`n` random unit vectors and a partner of each at a cosine of 0.95 to 0.956."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.normal(size=(n, width))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.956, size=(n, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * off])


def test_recall_with_the_values_in_use(spark):
    n = 20_000
    x = planted_pairs(n)
    table = pa.table({"vec_id": pa.array(range(2 * n), pa.int64()), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))})
    got = pq_dedup.near_vectors(spark.createDataFrame(table)).where("component_id <> vec_id").count()
    assert got / n >= 0.99


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pq_dedup.near_vectors(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pq_dedup.near_vectors(odd).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
