"""Jaccard self-join of word n-gram sets: rare-first prefixes, length, positional and suffix filters, one verification a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, small_batches
from .components import components
from .pieces import in_blocks
from .shingles import set_id, shingle_sets

#: Counters of the frequency sketch, a power of two: 4 MB for every task.
SKETCH = 1 << 20
SLAB = 1 << 16
#: Rows of a frequent shingle that are compared in one group when rows of single documents are dropped.
SALT_ROWS = 50_000
#: Lists up to this length are compared all with all, longer ones with one central member a round.
LIST_ROWS = 32
ROUNDS = 3
#: Characters whose shingles are made together.
BLOCK_CHARS = 1 << 18
#: Classes by hash whose counts the suffix filter compares.
CLASSES = 32
#: Keys of documents to verify up to which the list goes to every executor (8 bytes each).
BROADCAST_KEYS = 2_000_000


def _key(doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs)
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _scan(docs: DataFrame, words: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One reading of the texts: a row per document with its set's name, size and class counts; and the sketch's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(SKETCH, np.int64), False
        for batch in batches:
            at = 0
            for block in in_blocks((t.as_py() for t in batch.column("text")), BLOCK_CHARS):
                names, sizes, classes, low = [], [], [], []
                for tokens in shingle_sets(block, words):
                    low.append((tokens & np.uint64(SKETCH - 1)).astype(np.int64))
                    names.append(set_id(tokens) if len(tokens) else None)
                    sizes.append(len(tokens))
                    classes.append(np.bincount((tokens >> np.uint64(59)).astype(np.int64), minlength=CLASSES).astype("<i4"))
                counts += np.bincount(np.concatenate(low), minlength=SKETCH)
                yield _rows(batch.column("doc_id").slice(at, len(block)), names, sizes, classes)
                at += len(block)
                some = True
        if some:
            part = TaskContext.get().partitionId()
            for slab in range(SKETCH // SLAB):
                own = counts[slab * SLAB : (slab + 1) * SLAB].astype("<u4")
                yield _sketch_row(ids, part, slab, own.tobytes())

    kind = docs.schema[doc_id].dataType.simpleString()
    from .bpe_words import _arrow_type

    ids = _arrow_type(docs.sparkSession, kind)
    found = scratch(_texts(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, set_id long, n int, classes array<int>, part int, slab int, counts binary"))
    return found.where("slab is null").select("doc_id", "set_id", "n", "classes"), found.where("slab is not null").select("part", "slab", "counts")


NAMES = ["doc_id", "set_id", "n", "classes", "part", "slab", "counts"]


def _rows(ids: pa.Array, names: list, sizes: list, classes: list) -> pa.RecordBatch:
    n = len(names)
    null = lambda kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays([ids, pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(classes, pa.list_(pa.int32())), null(pa.int32()), null(pa.int32()), null(pa.binary())], names=NAMES)


def _sketch_row(ids: pa.DataType, part: int, slab: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(1, ids), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([part], pa.int32()), pa.array([slab], pa.int32()), pa.array([counts], pa.binary())], names=NAMES)


def _add_up(parts: DataFrame) -> np.ndarray:
    """The whole sketch: parts are added in groups of at most 256, level by level; its size is fixed."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), "<u4").astype(np.uint64) for c in table.column("counts"))
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([table.column("slab")[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["part", "slab", "counts"])

    schema = "part int, slab int, counts binary"
    last = parts.agg(F.max("part")).first()[0]
    while last is not None and last > 0:
        parts = parts.withColumn("part", F.floor(F.col("part") / 256).cast("int")).groupBy("part", "slab").applyInArrow(add, schema)
        last //= 256
    total = np.zeros(SKETCH, np.uint32)
    for row in parts.collect():
        total[row["slab"] * SLAB : (row["slab"] + 1) * SLAB] = np.frombuffer(row["counts"], "<u4")
    return total


def _prefixes(docs: DataFrame, sketch: np.ndarray, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(token, salt, salts, set_id, pos, n): the first shingles of each set in the order of estimated frequency, then hash.

    Any order that is the same for all documents gives the same links; the sketch
    makes it rare-first. A frequent shingle is spread over `salts` groups, a number
    that depends on the shingle alone.
    """
    floor = 2 * int(sketch.sum(dtype=np.uint64)) // SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks((t.as_py() for t in batch.column("text")), BLOCK_CHARS):
                token, salt, salts, names, pos, sizes = [], [], [], [], [], []
                for tokens in shingle_sets(block, words):
                    n = len(tokens)
                    if not n:
                        continue
                    often = sketch[tokens & np.uint64(SKETCH - 1)]
                    length = n - -(-percent * n // 100) + 1
                    first = np.lexsort((tokens, often))[:length]
                    name = set_id(tokens)
                    spread = 1 + np.maximum(0, often[first].astype(np.int64) - floor) // SALT_ROWS
                    token.append(tokens[first].view(np.int64)), salt.append(name % spread), salts.append(spread), names.append(np.full(length, name)), pos.append(np.arange(length, dtype=np.int32)), sizes.append(np.full(length, n, np.int32))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, salt, salts, names, pos, sizes)], names=["token", "salt", "salts", "set_id", "pos", "n"])

    return _texts(docs, doc_id, text).mapInArrow(run, "token long, salt long, salts long, set_id long, pos int, n int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """(token, set_id, pos, n) of shingles in the prefixes of at least two different sets."""
    group = Window.partitionBy("token", "salt")
    marked = prefixes.withColumn("low", F.min("set_id").over(group)).withColumn("high", F.max("set_id").over(group))
    kept = marked.where((F.col("low") != F.col("high")) | (F.col("salts") > 1))
    return scratch(kept.select("token", "set_id", "pos", "n").distinct())


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of sets of n and m that is enough."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent)).cast("int")


def _fits(a: str, b: str, percent: int) -> Column:
    """Length and positional filters: what both sets have from the shared shingle on must reach the needed intersection."""
    left, right = F.col(f"{a}n"), F.col(f"{b}n")
    room = F.least(left - F.col(f"{a}pos"), right - F.col(f"{b}pos"))
    return (F.lit(percent) * F.greatest(left, right) <= F.lit(100) * F.least(left, right)) & (room >= _needed(left, right, percent))


def _candidates(lists: DataFrame, percent: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """(pairs, lists that need another round).

    A list holds the sets with one shingle in their prefix. Only pairs across
    components matter. A short list gives its pairs at once; in a longer one the
    member in whose prefix the shingle stands first, the one with the fewest rare
    shingles, meets all others and then leaves the list.
    """
    # a member that no size in its list can match leaves it: (100 + percent) * room >= percent * (n + m)
    room = F.floor(F.lit(100 + percent) * (F.col("n") - F.col("pos")) / F.lit(percent)) - F.col("n")
    centre = F.struct("pos", F.xxhash64("set_id").alias("h"), "set_id", "comp", "n")
    stats = scratch(lists.groupBy("token").agg(F.min("n").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high"))
    open_ = lists.join(stats, "token").where((room >= F.col("least")) & (room >= F.ceil(F.lit(percent) * F.col("n") / 100))).select(*lists.columns)
    stats = open_.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(centre).alias("c")).where("low <> high")
    marked = scratch(open_.join(stats.select("token", "rows", "c"), "token"))
    long = marked.where((F.col("rows") > LIST_ROWS) if not last else F.lit(False))
    at = long.select("set_id", "comp", "n", "pos", F.col("c.set_id").alias("o_set_id"), F.col("c.comp").alias("o_comp"), F.col("c.n").alias("o_n"), F.col("c.pos").alias("o_pos"))
    star = at.where((F.col("comp") != F.col("o_comp")) & _fits("", "o_", percent)).select(F.least("set_id", "o_set_id").alias("x"), F.greatest("set_id", "o_set_id").alias("y"))
    short = marked.where((F.col("rows") <= LIST_ROWS) if not last else F.lit(True)).select("token", "set_id", "comp", "n", "pos")
    other = short.select("token", *[F.col(c).alias(f"o_{c}") for c in ("set_id", "comp", "n", "pos")])
    pairs = short.join(other, "token").where((F.col("set_id") < F.col("o_set_id")) & (F.col("comp") != F.col("o_comp")) & _fits("", "o_", percent)).select(F.col("set_id").alias("x"), F.col("o_set_id").alias("y"))
    rest = long.where(F.col("set_id") != F.col("c.set_id")).select("token", "set_id", "pos", "n")
    return scratch(star.unionByName(pairs).distinct()), rest


def _verify(docs: DataFrame, pairs: DataFrame, sets: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(a, b) of the pairs whose sets are similar enough, by their whole intersection.

    The suffix filter goes first: the sets can't share more than the smaller count
    of each hash class. Only sets of pairs that pass it are made again from the texts.
    """
    one = lambda name: sets.select(F.col("set_id").alias(name), F.col("n").alias(f"{name}n"), F.col("classes").alias(f"{name}c"))
    most = F.aggregate(F.zip_with("xc", "yc", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    passed = scratch(pairs.join(one("x"), "x").join(one("y"), "y").withColumn("need", _needed(F.col("xn"), F.col("yn"), percent)).where(most >= F.col("need")).select("x", "y", "need"))
    wanted = passed.select(F.col("x").alias("set_id")).unionByName(passed.select(F.col("y").alias("set_id"))).distinct()
    wanted = scratch(wanted.join(sets.select("set_id", "key"), "set_id"))
    keys = wanted.select("key").distinct()
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_KEYS else keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks((t.as_py() for t in batch.column("text")), BLOCK_CHARS):
                found = [t for t in shingle_sets(block, words) if len(t)]
                if found:
                    flat, offsets = np.concatenate(found).view(np.int64), np.cumsum([0, *map(len, found)])
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(t) for t in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["set_id", "tokens"])

    made = _texts(docs, doc_id, text).join(keys, _key("doc_id") == F.col("key"), "left_semi").mapInArrow(run, "set_id long, tokens array<long>")
    arrays = scratch(made.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))
    x, y = (arrays.select(F.col("set_id").alias(c), F.col("tokens").alias(f"{c}t")) for c in "xy")
    return scratch(passed.join(x, "x").join(y, "y").where(F.size(F.array_intersect("xt", "yt")) >= F.col("need")).select(F.col("x").alias("a"), F.col("y").alias("b")))


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    Two documents link when 100 * intersection >= `percent` * union of their sets of
    `words`-word shingles. component_id is the smallest doc_id that links reach,
    the row's own included.

    Rows with equal sets are one class, so copies are never paired. Classes meet in
    the lists of their prefix shingles. A pair whose classes are connected already
    needs no comparison, so a large group of near copies costs about one comparison
    a member, with its most central text; pairs across components are all looked at,
    none is left out.

    Null and empty text and text without words have 0 shingles and link with
    nothing. Repeated rows link like other copies. A null doc_id links too but is
    never the smallest id of a component that has another. An empty table gives an
    empty result.
    """
    per_doc, parts = _scan(docs, words, doc_id, text)
    sets = per_doc.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("classes").alias("classes"), F.min(_key("doc_id")).alias("key"))
    sets = scratch(sets)
    lists = _shared(_prefixes(docs, _add_up(parts), words, percent, doc_id, text))
    edges, labels, round_ = None, None, 0
    while True:
        round_ += 1
        known = lists.withColumn("comp", F.col("set_id")) if labels is None else lists.join(labels, "set_id", "left").withColumn("comp", F.coalesce("component", "set_id")).drop("component")
        pairs, lists = _candidates(known, percent, last=round_ >= ROUNDS)
        if not pairs.isEmpty():
            new = _verify(docs, pairs, sets, words, percent, doc_id, text)
            edges = new if edges is None else scratch(edges.unionByName(new))
            labels = scratch(components(edges).withColumnRenamed("node", "set_id"))
        if round_ >= ROUNDS or lists.isEmpty():
            break
    classed = per_doc.select("doc_id", "set_id", "n")
    if labels is not None:
        classed = classed.join(labels, "set_id", "left").withColumn("comp", F.coalesce("component", "set_id"))
    else:
        classed = classed.withColumn("comp", F.col("set_id"))
    # tables between an aggregate and its join leave a hot component to adaptive execution, which can't split an aggregate's rows
    classed = scratch(classed)
    least = scratch(classed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")).withColumnRenamed("comp", "of"))
    return classed.join(least, F.col("comp") == F.col("of"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
