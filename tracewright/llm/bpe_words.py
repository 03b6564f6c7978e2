"""Encoding and decoding through a table of the distinct words."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .pieces import NOT_PLAIN, encoder, in_blocks

#: Blocks whose entries of one word are gathered in one row.
BLOCKS_PER_GROUP = 4096

#: Words that a task holds before it packs them by block.
HELD_ROWS = 400_000

#: Numbers of blocks that an input partition has for itself; block and place of a word go in one long.
BLOCKS_OF_PART = 1024

#: White space of every definition; what else a tokenizer takes for space stays inside a word.
SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def _split(texts: list[str], enc) -> list[list[str]]:
    """Words whose ids, one after the other, are those of the text.

    Plain texts are cut where the tokenizer cuts them, which leaves fewer distinct
    words; others at white space, which no token spans.
    """
    out = []
    for text in texts:
        plain = enc.lower and enc.pattern is not None and NOT_PLAIN.search(text) is None and not (enc.special and enc.special.search(text))
        out.append(enc.pattern.findall(text.lower()) if plain else [w for w in SPACE.split(text) if w])
    return out


def _blocks(batches: Iterator[pa.RecordBatch], enc, max_words: int) -> Iterator[tuple[int, Iterator[tuple[list, list[list[str]]]]]]:
    """(block, its parts of doc ids and words): the same for the same input partition, so both passes agree.

    A partition with more blocks than it has numbers for is an error; smaller partitions or larger blocks avoid it.
    """
    number, source = TaskContext.get().partitionId() * BLOCKS_OF_PART, _parts(batches, enc)
    last = number + BLOCKS_OF_PART
    for first in source:
        if number == last:
            raise ValueError(f"more than {BLOCKS_OF_PART} blocks of {max_words} words in one input partition")

        def own() -> Iterator[tuple[list, list[list[str]]]]:
            part, size = first, 0
            while part is not None:
                yield part
                size += sum(map(len, part[1]))
                part = next(source, None) if size < max_words else None

        yield number, own()
        number += 1


def _parts(batches: Iterator[pa.RecordBatch], enc) -> Iterator[tuple[list, list[list[str]]]]:
    for batch in batches:
        at = 0
        for texts in in_blocks((t.as_py() for t in batch.column("text")), 1 << 19):
            yield batch.column("doc_id").slice(at, len(texts)).to_pylist(), _split(texts, enc)
            at += len(texts)


def _pack_places(places: list[list[int]]) -> bytes:
    """Small numbers, those of words that come early and so often, take a byte; the others four, whose bytes of one rank lie together."""
    flat = np.concatenate([np.asarray(p, "<u4") for p in places]) if places else np.empty(0, "<u4")
    wide = flat[flat >= 255]
    raw = np.minimum(flat, 255).astype(np.uint8).tobytes() + wide.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_places(data: bytes, count: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    flat = raw[:count].astype(np.int64)
    flat[flat == 255] = np.ascontiguousarray(raw[count:].reshape(4, -1).T).view("<u4").ravel()
    return flat


def word_round_trip(docs: DataFrame, tokenizer: str, max_words: int = 8_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded.

    The texts are split in Spark, and each block of documents has a list of its
    words. A word is encoded once for the blocks that have it, however often it
    stands there; its ids join the table of pieces to decode it; both go back to the
    blocks, where each document takes them by position. What is shuffled are the
    words of a block and the positions, not the texts and not one row per occurrence.

    `max_words` bounds a block but for its last document. The hashes are those of
    the decimal ids joined by one space and of the decoded text in UTF-8. Null and
    empty text have no ids and decode to the empty string. Repeated rows are encoded
    one by one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(docs)
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def emit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _blocks(batches, encoder(tokenizer), max_words):
            known: dict[str, None] = {}
            for _, texts in parts:
                for words in texts:
                    known.update(dict.fromkeys(words))
            words = list(known)
            for i in range(0, len(words), 1 << 16):
                part = words[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part)) + (number << 32)), pa.array(part)], names=["at", "word"])

    def emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _blocks(batches, encoder(tokenizer), max_words):
            known: dict[str, int] = {}
            for ids, texts in parts:
                places = []
                for words in texts:
                    for w in dict.fromkeys(words):
                        known.setdefault(w, len(known))
                    places.append(list(map(known.__getitem__, words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([ids], pa.list_(docs_type)), pa.array([[len(p) for p in places]], pa.list_(pa.int32())), pa.array([_pack_places(places)], pa.binary())],
                    names=["block", "doc_ids", "sizes", "packed"],
                )

    docs_type = _arrow_type(spark, kind)
    words = base.mapInArrow(emit_words, "at long, word string")
    places = base.mapInArrow(emit_places, f"block long, doc_ids array<{kind}>, sizes array<int>, packed binary")

    @F.pandas_udf("array<int>")
    def encode(word: pd.Series) -> pd.Series:
        enc = encoder(tokenizer)
        return pd.Series([np.frombuffer(b, enc.dtype).astype("<i4") for b in enc.encode_words(word.tolist())])

    def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their ids and pieces, put together again and packed by block.

        The rows of a word follow one another, as nothing since the explode has
        moved them.
        """
        rest, held, size = None, [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            starts = np.flatnonzero(table.column("n").fill_null(0).to_numpy() == 0)
            rest = table
            if len(starts) > 1:
                rest = table.slice(int(starts[-1])).combine_chunks()
                held.append(_joined(table, starts))
                size += held[-1].num_rows
                if size >= HELD_ROWS:
                    yield from _by_block(held)
                    held, size = [], 0
        if rest is not None and rest.num_rows:
            held.append(_joined(rest, np.array([0, rest.num_rows])))
        if held:
            yield from _by_block(held)

    group = F.floor(F.shiftright("at", 32) / F.lit(BLOCKS_PER_GROUP))
    table = words.groupBy("word", group.alias("group")).agg(F.collect_list("at").alias("at"))
    coded = table.select("at", encode("word").alias("ids"))
    # only the first row of a word carries its places
    exploded = coded.select("at", F.posexplode_outer("ids").alias("n", "id")).select(F.when(F.coalesce("n", F.lit(0)) == 0, F.col("at")).alias("at"), "n", "id")
    named = exploded.join(F.broadcast(piece_table(spark, tokenizer)), "id", "left").select("at", "n", "id", "piece")
    texts = named.mapInArrow(whole_words, "block long, entries binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(pa.py_buffer(e.as_py())).read_all() for e in right.column("entries")]
        n, ids, names = np.empty(0, np.int64), [], []
        if parts:
            entries = pa.concat_tables(parts)
            order = pa.array(np.argsort(entries.column("place").to_numpy()))
            n = entries.column("n").take(order).to_numpy()
            ids, names = (entries.column(c).take(order).to_pylist() for c in ("ids", "decoded"))
        # a word may have no ids, such as one of characters that the tokenizer drops
        some = n > 0
        out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for row in range(left.num_rows):
            doc_ids, sizes = (left.column(c)[row].as_py() for c in ("doc_ids", "sizes"))
            flat, at = _unpack_places(left.column("packed")[row].as_py(), sum(sizes)), 0
            for doc, size in zip(doc_ids, sizes):
                own = flat[at : at + size]
                at += size
                out["n_tokens"].append(int(n[own].sum()))
                own = own[some[own]].tolist()
                out["doc_id"].append(doc)
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(ids.__getitem__, own)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(" ".join(map(names.__getitem__, own)).encode()).hexdigest())
        return pa.table([pa.array(out["doc_id"], docs_type), pa.array(out["n_tokens"], pa.int64()), out["ids_sha256"], out["decoded_sha256"]], names=list(out))

    return places.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(assemble, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _joined(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """One row for each place of each word that begins at `starts`, but for the last, whose end isn't known."""
    ids, pieces = (table.column(c).to_pylist() for c in ("id", "piece"))
    spans = [(a, b) if ids[a] is not None else (a, a) for a, b in zip(starts.tolist(), starts[1:].tolist())]
    places = table.column("at").take(pa.array(starts[:-1])).combine_chunks()
    many = np.diff(places.offsets.to_numpy())
    at = places.flatten().to_numpy()
    word = pa.array(np.repeat(np.arange(len(spans)), many))
    n = pa.array([b - a for a, b in spans], pa.int32())
    texts = [pa.array([" ".join(map(str, ids[a:b])) for a, b in spans], pa.string()), pa.array([" ".join(pieces[a:b]) for a, b in spans], pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(at >> 32), pa.array((at & 0xFFFFFFFF).astype(np.int32)), n.take(word), *[t.take(word) for t in texts]], names=["block", "place", "n", "ids", "decoded"])


def _by_block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed row for each block that the held words stand in."""
    table = pa.Table.from_batches(held)
    block = table.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    table, block = table.drop_columns(["block"]).take(pa.array(order)).combine_chunks(), block[order]
    cuts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(a, b - a))
        yield pa.RecordBatch.from_arrays([pa.array([int(block[a])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "entries"])


def _arrow_type(spark: SparkSession, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.createDataFrame([], f"x {kind}").schema["x"].dataType)


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece) of the vocabulary file; its size is that of the vocabulary."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder") is not None:
        raise ValueError("pieces are joined by a space, as the library does without a decoder")
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    table = pa.table({"id": pa.array(list(pieces), pa.int32()), "piece": pa.array(list(pieces.values()))})
    return spark.createDataFrame(table)
