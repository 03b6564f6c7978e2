"""Token files in Arrow's IPC format: fixed-size-list batches of equal-length sequences and masks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.session import cut

from .common import small_batches
from .pieces import encoder, in_blocks

MANIFEST = "part int, tokens_file string, docs_file string, n_docs long, n_tokens long, n_sequences long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a Hadoop path; file:/x and file:///x are the same."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _publish(folder: str, name: str, write) -> str:
    """Write under a name of this attempt and rename, so that a repeated or doubled task leaves one whole file."""
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    tmp = f"{base}/_{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(tmp) as out:
        write(out)
    store.move(tmp, f"{base}/{name}")
    return f"{folder}/{name}"


class SequenceFile:
    """Cuts a stream of ids into sequences of `length` and writes them in batches of `rows`."""

    def __init__(self, out, length: int, dtype: np.dtype, rows: int = 512):
        self.length, self.dtype, self.rows = length, dtype, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(out, self.schema)
        self.waiting, self.size, self.sequences = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        while self.size >= self.length * self.rows:
            joined = np.concatenate(self.waiting)
            self._write(joined[: self.length * self.rows], self.length * self.rows)
            self.waiting = [joined[self.length * self.rows :]]
            self.size = len(self.waiting[0])

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        column = lambda flat, kind: pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([column(ids, pa.from_numpy_dtype(self.dtype)), column(mask, pa.bool_())], schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> None:
        rest = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.dtype)
        if len(rest):
            self._write(np.pad(rest, (0, -len(rest) % self.length)), len(rest))
        self.writer.close()


class MappedSequences:
    """Random access to the sequences of a token file that is mapped into memory.

    `len(file)` sequences; `file[k]` gives the ids as a view of the mapped file,
    nothing of which is copied or read beyond the touched pages, and the mask, whose
    bits become one byte each. A number outside the file is an IndexError. Only for
    files of a local or mounted folder.
    """

    def __init__(self, path: str):
        store, path = _open(path)
        if not isinstance(store, fs.LocalFileSystem):
            raise ValueError(f"{path} can't be mapped")
        self._source = pa.memory_map(path)
        self._file = pa.ipc.open_file(self._source)
        self.length = self._file.schema.field("ids").type.list_size
        # all batches but the last have as many rows
        self._rows = self._file.get_batch(0).num_rows
        self._size = (self._file.num_record_batches - 1) * self._rows + self._file.get_batch(self._file.num_record_batches - 1).num_rows

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= k < self._size:
            raise IndexError(k)
        batch, at = self._file.get_batch(k // self._rows), k % self._rows * self.length
        ids, mask = (batch.column(c).values.slice(at, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048, files: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids in ascending `doc_id` order and return one manifest row per file pair.

    Each range of ids has a token file, whose batches hold fixed-size lists of ids
    (the smallest unsigned type that fits the vocabulary) and of the mask, and a
    documents file (doc_id, start within the token file, n_tokens). The last
    sequence of a file is padded with 0 and masked. Nothing is compressed, so a
    reader maps the file and takes any sequence or document without copying.

    Each text's ids are followed by `end_id`; null text is empty. A null doc_id comes
    first, rows with the same id follow one another in order of their text. An empty
    table writes no file. `folder` must be one that executors share.
    `files` is about the number of token files, by default the session's shuffle partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, enc, index, starts, counts, made = TaskContext.get().partitionId(), encoder(tokenizer), [], [], [], []

        def write(out) -> None:
            file, at = SequenceFile(out, length, enc.dtype), 0
            for batch in (b for source in ([first], batches) for b in source):
                for block in in_blocks(t.as_py() for t in batch.column("text")):
                    for encoded in enc.encode(block):
                        ids = np.append(np.frombuffer(encoded, enc.dtype), enc.dtype.type(end_id))
                        file.add(ids)
                        starts.append(at), counts.append(len(ids))
                        at += len(ids)
                index.append(batch.column("doc_id"))
            file.close()
            made.extend((at, file.sequences))

        tokens = _publish(folder, f"tokens-{part:06d}.arrow", write)

        def write_index(out) -> None:
            table = pa.table({"doc_id": pa.chunked_array(index), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            with pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table, 1 << 16)

        named = _publish(folder, f"docs-{part:06d}.arrow", write_index)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tokens_file": [tokens], "docs_file": [named], "n_docs": [len(starts)], "n_tokens": [made[0]], "n_sequences": [made[1]]})

    small_batches(docs)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = base.repartitionByRange(files, "doc_id") if files else base.repartitionByRange("doc_id")
    ordered = ranges.sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, MANIFEST))


def read_documents(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint", checksums: bool = False) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids) from the files: `start` within the part, `ids` little-endian unsigned 32-bit.

    With `checksums` the CRC-32 of those bytes, ids_crc32, stands in place of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row["part"], row["tokens_file"], row["docs_file"], checksums)

    files = max(1, manifest.count())
    spread = manifest.select("part", "tokens_file", "docs_file").repartitionByRange(files, "part")
    return spread.mapInArrow(run, f"part int, doc_id {id_type}, start long, n_tokens long, {'ids_crc32 long' if checksums else 'ids binary'}")


def _documents(part: int, tokens_file: str, docs_file: str, checksums: bool, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Documents in file order; of the token file only the batches under the present rows are in memory."""
    last, made, kind = ("ids_crc32", zlib.crc32, pa.int64()) if checksums else ("ids", bytes, pa.binary())
    store, path = _open(docs_file)
    with store.open_input_file(path) as f:
        docs = pa.ipc.open_file(f).read_all()
    store, path = _open(tokens_file)
    with store.open_input_file(path) as f:
        file = pa.ipc.open_file(f)
        held, base, following = np.empty(0), 0, 0
        for i in range(0, docs.num_rows, rows):
            some = docs.slice(i, rows)
            starts, counts = (some.column(c).to_numpy() for c in ("start", "n_tokens"))
            end = int(starts[-1] + counts[-1])
            held, base = held[int(starts[0]) - base :], int(starts[0])
            while base + len(held) < end:
                batch = file.get_batch(following)
                ids, mask = (batch.column(c).flatten() for c in ("ids", "mask"))
                held = np.concatenate([held, ids.filter(mask).to_numpy()]) if len(held) else ids.filter(mask).to_numpy()
                following += 1
            data = [made(held[s - base : s - base + n].astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * some.num_rows, pa.int32()), some.column("doc_id").combine_chunks(), pa.array(starts), pa.array(counts), pa.array(data, kind)],
                names=["part", "doc_id", "start", "n_tokens", last],
            )


def part_starts(manifest: DataFrame) -> DataFrame:
    """(part, before): ids in all files before; one row per file goes through the window."""
    return manifest.select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
