"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.session import cut

from .common import scratch, small_batches
from .pieces import encoder, in_blocks

#: Counts of (length, part) up to which they are broadcast; beyond it they meet the pieces by a shuffle.
BROADCAST_ROWS = 200_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, narrow: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, own, piece, start, length, ids): each text's ids with `end_id` after them, in pieces of at most `capacity`.

    Only a text of more ids than that is cut; then all pieces but the first are
    full. `ids` are little-endian unsigned 32-bit integers. `part` is the task that
    made a piece and `own` counts the pieces of its length before it there, so the
    rows must be written before they are used twice. Null text is empty: one piece with
    the end id alone. With `narrow` the ids are of the smallest unsigned type that fits
    the vocabulary: half the bytes below 65,536 pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, had = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        kind = enc.dtype if narrow else np.dtype("<u4")
        end, wide = kind.type(end_id).tobytes(), kind.itemsize
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for block in in_blocks(t.as_py() for t in batch.column("text")):
                src, own, piece, start, size, data = [], [], [], [], [], []
                for i, encoded in enumerate(enc.encode(block)):
                    whole = (encoded if kind == enc.dtype else np.frombuffer(encoded, enc.dtype).astype(kind).tobytes()) + end
                    count = len(whole) // wide
                    cuts = [0, *range((count - 1) % capacity + 1, count + 1, capacity)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        src.append(at + i), own.append(had[b - a]), piece.append(n), start.append(a), size.append(b - a), data.append(whole[a * wide : b * wide])
                        had[b - a] += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(src, pa.int64())), pa.array([task] * len(src), pa.int32()), pa.array(own, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())],
                    names=["doc_id", "part", "own", "piece", "start", "length", "ids"],
                )
                at += len(block)

    small_batches(docs)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, part int, own long, piece int, start long, length long, ids binary")


class OpenBins:
    """Segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least `need` that an open bin has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts of lengths: rows (length, first rank, per bin, first bin, offset).

    Items are taken from the longest to the shortest, each into the tightest open
    bin that holds it. After an item went in, that bin is the tightest for the next
    item of the same length as long as it fits, so equal bins take equal shares and
    are kept as ranges. Work and result depend on the number of different lengths
    and rooms, at most `capacity` of each, not on the number of items.
    """
    tree, ranges, bins, out = OpenBins(capacity), {}, 0, []

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            ranges.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = ranges[room].pop()
                tree.add(room, -n)
            each = room // length
            used = min(n, -(-left // each))
            items = min(left, used * each)
            out.append((length, rank, each, first, capacity - room))
            full, part = divmod(items, each)
            give(room - each * length, first, full)
            give(room - part * length, first + full, 1 if part else 0)
            give(room, first + used, n - used)
            rank, left = rank + items, left - items
    return np.array(out, np.int64).reshape(-1, 5)


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Written `pieces` of token_pieces() with `sequence_id` and `offset`, gapless from 0 in each sequence.

    The driver sees only the counts per length, at most `capacity` rows. A piece's rank
    within its length is `own` and what the parts before its own have of that length;
    only these counts are shuffled, so a length that most pieces have is no
    hot key. Equal lengths may change places with each other, nothing else. An empty
    table gives an empty result.
    """
    per = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("_n")))
    rows = per.groupBy("length").agg(F.sum("_n")).collect()
    runs = plan({r[0]: r[1] for r in rows}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(F.broadcast(per) if per.count() <= BROADCAST_ROWS else per, ["length", "part"]).withColumn("_rank", F.col("own") + F.col("_before"))

    # runs of a length lie together and in order of rank, so one search in length * scale + rank finds an item's run
    scale = int(max((r[1] for r in rows), default=0)) + 1
    keys = runs[:, 0] * scale + runs[:, 1]
    at = np.argsort(keys)
    runs, keys = runs[at], keys[at]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = runs[np.searchsorted(keys, size * scale + rank, side="right") - 1]
            item = rank - run[:, 1]
            columns = {c: batch.column(c) for c in names} | {"sequence_id": pa.array(run[:, 3] + item // run[:, 2]), "offset": pa.array(run[:, 4] + item % run[:, 2] * size)}
            yield pa.RecordBatch.from_pydict(columns)

    names = [c for c in pieces.columns if c not in ("part", "own")]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, parts): the packed sequences of what assign() placed.

    `ids` are those of all its pieces one after another, `parts` says whose they are:
    (doc_id, piece, start, length, offset) in order of offset. The pieces of a
    sequence meet in one partition, sorted, and are glued as they come by; at most one
    unfinished sequence waits for the next batch.
    """
    named = ["doc_id", "piece", "start", "length", "offset"]

    def glue(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("sequence_id", "length"))
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        edges = pa.array(np.r_[first, len(ids)], pa.int32())
        parts = pa.StructArray.from_arrays([rows.column(c) for c in named], names=named)
        joined = pc.binary_join(pa.ListArray.from_arrays(edges, rows.column("ids")), b"")
        return pa.RecordBatch.from_pydict({"sequence_id": ids[first], "length": np.add.reduceat(size, first), "ids": joined, "parts": pa.ListArray.from_arrays(edges, parts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if waiting is None else pa.concat_batches([waiting, batch])
            ids = rows.column("sequence_id").to_numpy()
            done = int(np.searchsorted(ids, ids[-1]))
            if done:
                yield glue(rows.slice(0, done))
            waiting = rows.slice(done)
        if waiting is not None:
            yield glue(waiting)

    kinds = ", ".join(f"{c}: {placed.schema[c].dataType.simpleString()}" for c in named)
    together = placed.select("sequence_id", *named, "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return together.mapInArrow(run, f"sequence_id long, length long, ids binary, parts array<struct<{kinds}>>")


def pieces_of(stored: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of what lies in packed sequences, null doc_ids included.

    Every piece's ids are cut out of its sequence; the checksum is that of the ids as
    little-endian unsigned 32-bit integers, whatever the width they are stored in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(b, f"<u{len(b) // n}").astype("<u4").tobytes()) for b, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids_crc32", pa.array(sums, pa.int64()))

    width = (F.octet_length("ids") / F.col("whole")).cast("int")
    each = stored.select("sequence_id", "ids", F.col("length").alias("whole"), F.inline("parts"))
    own = F.substring("ids", (F.col("offset") * width + 1).cast("int"), (F.col("length") * width).cast("int")).alias("ids")
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = each.select("doc_id", "piece", "start", "length", own, "sequence_id", "offset")
    schema = ", ".join(f"{'ids_crc32' if c == 'ids' else c} {'long' if c == 'ids' else rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, schema)


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences of all texts, as sequences() describes them, written to the shared folder.

    The texts are tokenised once into a table of pieces; lengths alone decide the
    places, the ids go with their pieces. Null text is empty and gives its end id; rows
    that repeat, also with the same or a null doc_id, are packed one by one; a text
    of any length is cut into pieces; an empty table gives no sequence.
    """
    kept = scratch(token_pieces(docs, tokenizer, capacity, end_id, narrow=True), "zstd")
    return scratch(sequences(assign(kept, capacity)), "zstd")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces, read back from the packed sequences."""
    return pieces_of(pack_sequences(docs, tokenizer, capacity, end_id))
