"""Resampling towards a target by the importance of hashed word n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, small_batches

#: A-Z become a-z; a-z, 0-9 and all bytes beyond ASCII stay; everything else is a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8; no byte of a longer character is below 128, so the table never cuts one."""
    return text.translate(WORD_BYTES).split()


def buckets_of(words: list[bytes], buckets: int, order: int = 2) -> np.ndarray:
    """Bucket of every run of 1 to `order` words: the CRC-32 of a run goes on from that of the run without its last word."""
    if not words:
        return np.empty(0, np.uint32)
    level = list(map(zlib.crc32, words))
    every = level
    spaced = [b" " + w for w in words]
    for size in range(1, order):
        level = list(map(zlib.crc32, spaced[size:], level[:-1]))
        every = every + level
    return np.array(every, np.uint32) % np.uint32(buckets)


def features(docs: DataFrame, buckets: int = 10_000, order: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, found): each row's buckets as little-endian numbers of two bytes, or four where `buckets` needs them."""
    wide = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, found = [], [], []
            for value in batch.column("text"):
                words = words_of(value.as_buffer().to_pybytes())
                got = buckets_of(words, buckets, order)
                n_words.append(len(words)), n_features.append(len(got)), found.append(got.astype(wide).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_words", "n_features", "found"])

    small_batches(docs)
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return base.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_features long, found binary")


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): one Counter a task, at most `buckets` rows of it are shuffled."""
    wide = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column("found"):
                seen.update(np.frombuffer(value.as_buffer(), wide).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen.keys(), pa.int64()), "n": pa.array(seen.values(), pa.int64())})

    return found.select("found").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """Of every bucket, floor(1000 * ln of its share of the target over its share of the source), both with one added."""
    spread = lambda counts: np.array([counts.get(b, 0) for b in range(buckets)], np.float64)
    s, t = spread(source), spread(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(found: DataFrame, gain: np.ndarray, buckets: int = 10_000) -> DataFrame:
    """`found` with `weight`, the floored mean gain of its features, in place of them; 0 without features."""
    wide = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = (np.frombuffer(value.as_buffer(), wide) for value in batch.column("found"))
            weight = pa.array([int(gain[b].sum()) // len(b) if len(b) else 0 for b in each], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), weight], names=["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int, key: Column) -> Column:
    """1000 times a Gumbel draw from the hash of `seed:key`, floored; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], column: str = "rank") -> DataFrame:
    """`rows` numbered from 1 in `order`, with ties in any order.

    Ranges of rows are written as they lie; each numbers its own and adds the sizes
    of those before it, of which there are as many as partitions.
    """
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    spread = scratch(spread.repartitionByRange(*order, F.col("_row")).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order, F.col("_row")))
    return spread.withColumn("_own", own).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias(column))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, order: int = 2, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): one row per row of `docs`; rank counts from 1 among those drawn, null is not drawn.

    The weight is the mean log ratio of a document's features in `target` and in
    `docs`, over all rows of both; with its Gumbel noise added, the highest scores
    are a draw without replacement by importance. Of the rows with at least
    `min_words` words `percent` in a hundred are drawn, floored.

    Bucket counts are `buckets` rows whatever the input, and only they reach the
    driver. Ranks come from a range partitioning by (score, doc_id), so neither a
    common score nor an id of many rows lies in one task.

    Null text has no words, no features and weight 0. A null id draws noise as an
    empty one and comes first among equal scores; rows that repeat count each, are
    drawn each and share no rank. An empty table gives an empty result; an empty
    target still weighs, as nothing is in it. Only id and text are read.
    """
    found = scratch(features(docs, buckets, order, doc_id, text))
    wanted = features(target.select(F.lit(0).alias("doc_id"), F.col(f"`{target_text}`").alias("text")), buckets, order)
    as_dict = lambda counts: {r["bucket"]: r["n"] for r in counts.collect()}
    gain = gains(as_dict(bucket_counts(found, buckets)), as_dict(bucket_counts(wanted, buckets)), buckets)
    scored = scratch(weigh(found, gain, buckets).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))))

    long_enough = F.col("n_words") >= min_words
    drawn = scored.where(long_enough).count() * percent // 100
    order_by = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    placed = ranked(scored.where(long_enough), order_by).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")
