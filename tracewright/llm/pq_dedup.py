"""Embedding near-duplicates: inverted lists, product-quantised residuals, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .components import components

#: Vectors that the index is fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
#: Mean vectors of a list, and most lists.
LIST_SIZE, MAX_LISTS = 200, 4096
PARTS, CODES = 8, 256
#: Lists that a vector visits.
PROBES = 8
#: Members and visitors of a list that one task compares.
MEMBERS, VISITORS = 2048, 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centre)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        some = count > 0
        centre[some] = total[some] / count[some, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centre.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Index:
    """Coarse centres of unit vectors and codebooks of what is left, one for each part of the dimensions."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centre = _kmeans(sample, min(lists, len(sample)), rng)
        rest = sample - self.centre[_nearest(sample, self.centre)]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], min(CODES, len(sample)), rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists by nearness, codes in the nearest one, length of what the codes leave out)."""
        half = (self.centre**2).sum(axis=1) / 2
        probes = np.argsort(half - x @ self.centre.T, axis=1, kind="stable")[:, :PROBES]
        rest = x - self.centre[probes[:, 0]]
        codes = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1).astype(np.uint8)
        guess = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return probes, codes, np.linalg.norm(rest - guess, axis=1)

    def tables(self, q: np.ndarray, home: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Products of each query with a list's centre and with every codeword."""
        return q @ self.centre[home], [q[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)]


def _unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _links(index: Index, home: int, q: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) numbers of pairs with at least `cosine`.

    A looked-up product differs from the exact one by no more than the length the
    codes leave out, so no pair is lost before the exact cosine in double precision.
    """
    rows, columns = [], []
    for i in range(0, len(q), 256):
        base, tables = index.tables(q[i : i + 256], home)
        near = base[:, None] + sum(t[:, codes[:, m]] for m, t in enumerate(tables))
        a, b = np.nonzero(near >= cosine - left - 1e-9)
        for j in range(0, len(a), 1 << 16):
            qa, xb = a[j : j + (1 << 16)] + i, b[j : j + (1 << 16)]
            exact = np.einsum("ij,ij->i", q[qa], x[xb]) >= cosine
            rows.append(qa[exact]), columns.append(xb[exact])
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of links that join two parts not yet joined: at most one for each vector."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    kept = []
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        if (r := root(u)) != (s := root(v)):
            parent[r] = s
            kept.append(i)
    return kept


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`.

    Rows link when their cosine in double precision is at least `cosine`. n_links
    counts the other rows linked directly, component_id is the smallest vec_id that
    links reach, the row's own included, and kept marks the row whose id that is.

    Equal vectors are one class of the index, with their number. A class is a member
    of the list of its nearest centre and visits PROBES lists; each visit compares it
    with all members, so a pair is found if either visits the other's list. Lists are
    split by members and by visitors, so a crowded one is many bounded groups, each
    of which returns counts and a spanning forest, not its pairs.

    Vectors of one length are indexed by themselves; lengths of up to LIST_SIZE
    vectors, which would be one list, are compared whole, each in a group. Null
    vectors and those of zeros only or with a null or non-finite component link with
    nothing. Repeated rows are equal vectors. A null vec_id links too but is never the smallest id. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are equal numbers
    base = base.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    base = base.withColumn("class", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = scratch(base.where("class is not null").groupBy("class").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("rows")).withColumn("width", F.size("v")))
    widths = classes.groupBy("width").count()
    # at most one row for each LIST_SIZE vectors
    large = {r["width"]: r["count"] for r in widths.where(F.col("count") > LIST_SIZE).orderBy("width").collect()}
    sums, edges = _compare_few(classes.where(~F.col("width").isin(list(large))), cosine)
    for width, total in large.items():
        more_sums, more_edges = _search(classes.where(F.col("width") == width), total, cosine)
        sums, edges = sums.unionByName(more_sums), edges.unionByName(more_edges)
    label = components(edges).withColumnRenamed("node", "class")
    known = classes.select("class", "least", "rows").join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").join(sums, "class", "left").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"))
    return base.select("vec_id", "class").join(known, "class", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def fit(classes: DataFrame, total: int) -> Index:
    """From at most SAMPLE classes, the first by their hash."""
    rows = classes.select("class", "v").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).toArrow()
    sample = np.asarray(rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(rows.num_rows, -1)
    return Index(_unit(sample), max(1, min(MAX_LISTS, total // LIST_SIZE)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _compare_few(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """As _search, for lengths of few vectors: all those of a length in one group."""

    def compare(table: pa.Table) -> pa.Table:
        ids, rows, unit = table.column("class").to_numpy(), table.column("rows").to_numpy(), _unit(_matrix(table.column("v")))
        a, b = np.nonzero(np.triu(np.einsum("ik,jk->ij", unit, unit) >= cosine, 1))
        links = (np.bincount(a, rows[b], len(ids)) + np.bincount(b, rows[a], len(ids))).astype(np.int64)
        span = _spanning(ids[a], ids[b])
        none = [None] * len(span)
        return pa.table({
            "class": pa.array(ids.tolist() + ids[a][span].tolist(), pa.int64()), "links": pa.array(links.tolist() + none, pa.int64()),
            "other": pa.array([None] * len(ids) + ids[b][span].tolist(), pa.int64()),
        })

    found = scratch(classes.select("width", "class", "rows", "v").groupBy("width").applyInArrow(compare, "class long, links long, other long"))
    return found.where("links is not null").select("class", "links"), found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))


def _search(classes: DataFrame, total: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """((class, links), (a, b)): linked rows of other classes, and links that span the components."""
    index = fit(classes, total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                probes, codes, left = index.add(_unit(_matrix(batch.column("v"))))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(probes.ravel().astype(np.int32)), probes.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("rows"), batch.column("v"), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=["class", "rows", "v", "probes", "codes", "left"])

    placed = scratch(classes.select("class", "rows", "v").mapInArrow(place, "class long, rows long, v array<double>, probes array<int>, codes binary, left double"))
    # at most MAX_LISTS rows
    sizes = placed.groupBy(F.get("probes", F.lit(0)).alias("list")).agg(F.count("*").alias("members"))
    visits = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("visits"))
    split = sizes.join(visits, "list").select("list", F.ceil(F.col("members") / MEMBERS).cast("int").alias("m"), F.ceil(F.col("visits") / VISITORS).cast("int").alias("n"))
    split = F.broadcast(scratch(split))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    member = placed.withColumn("list", F.get("probes", F.lit(0))).join(split, "list").withColumn("mb", F.pmod(F.xxhash64("class"), F.col("m")).cast("int")).withColumn("nb", F.explode(every("n"))).withColumn("member", F.lit(True))
    visitor = placed.withColumn("list", F.explode("probes")).join(split, "list").withColumn("nb", F.pmod(F.xxhash64("class"), F.col("n")).cast("int")).withColumn("mb", F.explode(every("m"))).withColumn("member", F.lit(False))
    names = ["list", "mb", "nb", "member", "class", "rows", "v", "probes", "codes", "left"]

    def compare(table: pa.Table) -> pa.Table:
        home = table.column("list")[0].as_py()
        inside = np.asarray(table.column("member").to_numpy(zero_copy_only=False), bool)
        m, v = table.filter(pa.array(inside)), table.filter(pa.array(~inside))
        out = {"class": [], "links": [], "other": []}
        if m.num_rows and v.num_rows:
            codes = np.frombuffer(b"".join(m.column("codes").to_pylist()), np.uint8).reshape(m.num_rows, -1)
            a, b = _links(index, home, _unit(_matrix(v.column("v"))), _unit(_matrix(m.column("v"))), codes, m.column("left").to_numpy(), cosine)
            ids, theirs = v.column("class").to_numpy(), m.column("class").to_numpy()
            probes, theirs_probes = _matrix(v.column("probes")), _matrix(m.column("probes"))
            # a pair that the other list finds too counts in the smaller list, one of the same list from its smaller class
            own = probes[a, 0]
            back = (theirs_probes[b] == own[:, None]).any(axis=1)
            keep = np.where(own == home, ids[a] < theirs[b], ~back | (home < own))
            a, b = a[keep], b[keep]
            both = np.concatenate([ids[a], theirs[b]])
            many = np.concatenate([m.column("rows").to_numpy()[b], v.column("rows").to_numpy()[a]])
            names_, at = np.unique(both, return_inverse=True)
            out["class"], out["links"] = names_.tolist(), np.bincount(at, many).astype(np.int64).tolist()
            out["other"] = [None] * len(names_)
            span = _spanning(ids[a], theirs[b])
            out["class"] += ids[a][span].tolist()
            out["links"] += [None] * len(span)
            out["other"] += theirs[b][span].tolist()
        return pa.table({"class": pa.array(out["class"], pa.int64()), "links": pa.array(out["links"], pa.int64()), "other": pa.array(out["other"], pa.int64())})

    found = scratch(member.select(*names).unionByName(visitor.select(*names)).groupBy("list", "mb", "nb").applyInArrow(compare, "class long, links long, other long"))
    sums = found.where("links is not null").groupBy("class").agg(F.sum("links").alias("links"))
    return sums, found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))
