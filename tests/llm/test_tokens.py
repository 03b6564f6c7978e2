"""Ids of whole texts, packing, token files and the word table against the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import arrow_tokens, bpe_words, packing, pieces
from tracewright.llm.common import scratch, shared_folder

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
TEXTS = [
    "Hello world, it's 2024!!  Don't\n\n stop ", "", None, " ", "\n", "a", "ÀÉÎ õü ß ſ Ŀ", "İstanbul ΣΑΣ ﬁ", "x<|endoftext|>y", "tab\tand\x0bvt\x1cfs\x85nel em", "１２ ½ ² 3.14159", "日本語 текст é",
    "'S 'Ll we'LL 'tis '0 0 00 0a", "long " * 4000, "nospace" * 2000, "0 \n 0", "\n".join("word%d" % i for i in range(300)), "a", "a",
]


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("limit", [10, 10_000])
def test_pieces_agree_with_the_library(path, limit):
    enc = pieces.PieceEncoder(path, limit)
    assert enc.pattern is not None
    for _ in range(2):
        got = enc.encode([t or "" for t in TEXTS])
        assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [ids(path, t) for t in TEXTS]


ENCODERS = {p: pieces.PieceEncoder(p, 50) for p in (BYTES, WORDS)}


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab 'stlvmdreZ09.\n\t\r!éÀİ"), st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]))))
def test_any_text(text):
    for path, enc in ENCODERS.items():
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ids(path, text)


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(100 - i, t, 1, "r", 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, row string, length int").repartition(3)


def test_best_fit_decreasing():
    """The plan over counts fills as item by item."""
    rng = random.Random(1)
    for capacity in (7, 64, 100):
        sizes = [rng.randint(1, capacity) for _ in range(400)]
        bins = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, room in enumerate(bins) if room >= s]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= s
            else:
                bins.append(capacity - s)
        runs = packing.plan({s: sizes.count(s) for s in set(sizes)}, capacity)
        room = {}
        for length, _, each, first, offset in runs.tolist():
            assert offset % 1 == 0 and each >= 1 and offset + each * length <= capacity
            room[first] = 1
        last = max(first + -(-n // each) for (length, rank, each, first, _), n in zip(runs.tolist(), counts(runs, sizes)))
        assert last == len(bins)


def counts(runs, sizes):
    out = []
    for i, (length, rank, *_rest) in enumerate(runs.tolist()):
        following = [r[1] for r in runs.tolist()[i + 1 :] if r[0] == length]
        out.append((following[0] if following else sizes.count(length)) - rank)
    return out


def test_tightest_open_bin():
    tree, rng, have = packing.OpenBins(50), random.Random(2), []
    for _ in range(300):
        if have and rng.random() < 0.4:
            tree.add(have.pop(rng.randrange(len(have))), -1)
        else:
            have.append(rng.randint(0, 50))
            tree.add(have[-1], 1)
        need = rng.randint(1, 50)
        assert tree.tightest(need) == min((r for r in have if r >= need), default=None)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_packed_pieces(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast_rows)
    docs = table(spark).repartition(3)
    got = packing.pack(docs, BYTES, capacity=64, end_id=0).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        own = np.array(ids(BYTES, t) + [0], "<u4")
        rows = sorted(by_doc[100 - i], key=lambda r: r["piece"])
        cuts = [0, *range((len(own) - 1) % 64 + 1, len(own) + 1, 64)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows] == [(n, a, b - a, zlib.crc32(own[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    total = sum(r["length"] for r in got)
    assert -(-total // 64) <= len(by_sequence) <= -(-total // 64) + 1
    for places in by_sequence.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 64
    assert packing.pack(docs.limit(0), BYTES, 64).count() == 0


def test_packed_sequences(spark):
    placed = packing.assign(scratch(packing.token_pieces(table(spark, TEXTS[:8]), BYTES, 16, 0)), 16)
    whole = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    assert sum(r["length"] for r in whole.values()) == sum(len(ids(BYTES, t)) + 1 for t in TEXTS[:8])
    assert all(len(r["ids"]) == 4 * r["length"] <= 64 for r in whole.values())


@pytest.mark.parametrize("batch", [1000, 3])
def test_stored_sequences_decode(spark, monkeypatch, batch):
    monkeypatch.setattr(packing, "small_batches", lambda df: None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        # rows that repeat, an id on two texts, rows without an id or a text, and many of one token
        rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(7, "same"), (7, "same"), (7, "other"), (None, "no id"), (8, None), (None, None)] + [(9, "")] * 70
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        stored = packing.pack_sequences(docs, BYTES, capacity=64, end_id=0)
        got, listed = stored.collect(), packing.pieces_of(stored).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len({r["sequence_id"] for r in got}) == len(got)
    found = {}
    for r in got:
        own, at = np.frombuffer(bytes(r["ids"]), "<u2"), 0
        assert len(own) == r["length"] <= 64
        for p in r["parts"]:
            assert p["offset"] == at
            found.setdefault(p["doc_id"], []).append((p["start"], p["piece"], own[at : at + p["length"]].tolist()))
            at += p["length"]
        assert at == r["length"]
    for doc in {d for d, _ in rows}:
        pieces = sorted(found[doc])
        want = [ids(BYTES, t or "") + [0] for d, t in rows if d == doc]
        if len(want) == 1:
            assert [x for _, _, p in pieces for x in p] == want[0]
            assert LIBRARY[BYTES].decode([x for _, _, p in pieces for x in p][:-1], skip_special_tokens=False) == (next(t for d, t in rows if d == doc) or "")
        else:
            assert sorted(p for _, _, p in pieces) == sorted(want)
    flat = sorted((r["sequence_id"], r["offset"], r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in listed)
    crc = lambda r, p: zlib.crc32(np.frombuffer(bytes(r["ids"]), "<u2")[p["offset"] : p["offset"] + p["length"]].astype("<u4").tobytes())
    assert flat == sorted((r["sequence_id"], p["offset"], p["doc_id"] or -1, p["piece"], p["start"], p["length"], crc(r, p)) for r in got for p in r["parts"])


def test_token_files(spark):
    docs = table(spark)
    manifest = arrow_tokens.write_tokens(docs, shared_folder(spark), WORDS, end_id=1, length=16)
    rows = arrow_tokens.read_documents(spark, manifest).join(arrow_tokens.part_starts(manifest), "part").select("doc_id", F.col("start") + F.col("before"), "n_tokens", "ids").collect()
    at, want = 0, []
    for doc, text in sorted((100 - i, t) for i, t in enumerate(TEXTS)):
        own = np.array(ids(WORDS, text) + [1], "<u4")
        want.append((doc, at, len(own), own.tobytes()))
        at += len(own)
    assert sorted(map(tuple, rows)) == [(*w[:3], bytearray(w[3])) for w in want]
    for row in manifest.collect():
        with pa.memory_map(row["tokens_file"].removeprefix("file:")) as source:
            file = pa.ipc.open_file(source)
            batches = [file.get_batch(i) for i in range(file.num_record_batches)]
            assert {b.schema.field("ids").type for b in batches} == {pa.list_(pa.uint16(), 16)}
            assert sum(b.num_rows for b in batches) == row["n_sequences"] == -(-row["n_tokens"] // 16)
            assert sum(sum(b.column("mask").flatten().to_pylist()) for b in batches) == row["n_tokens"]


def test_sequences_are_views_of_the_mapped_file(tmp_path):
    stream = np.arange(5 * 4096 * 3 + 100, dtype="<u2")
    path = tmp_path / "tokens.arrow"
    with open(path, "wb") as out:
        file = arrow_tokens.SequenceFile(out, 4096, np.dtype("<u2"), rows=3)
        for part in np.array_split(stream, 7):
            file.add(part)
        file.close()
    mapped = arrow_tokens.MappedSequences(f"file:{path}")
    assert len(mapped) == file.sequences == 16
    before, held = pa.total_allocated_bytes(), []
    for k in (15, 0, 7, 3):
        ids, mask = mapped[k]
        own = stream[k * 4096 : (k + 1) * 4096]
        assert not ids.flags.owndata and not ids.flags.writeable
        assert ids[: len(own)].tolist() == own.tolist() and mask.tolist() == [i < len(own) for i in range(4096)]
        held.append(ids)
    # the ids of four sequences are held, and none of their bytes was allocated
    del mask
    assert len(held) == 4 and pa.total_allocated_bytes() == before
    with pytest.raises(IndexError):
        mapped[16]


def test_token_files_of_nothing_and_of_ties(spark):
    empty = arrow_tokens.write_tokens(table(spark).limit(0), shared_folder(spark), WORDS, end_id=1)
    assert empty.count() == 0 and arrow_tokens.read_documents(spark, empty).count() == 0
    docs = spark.createDataFrame([(3, "b c"), (None, "n"), (3, "a"), (3, "a")], "doc_id long, text string")
    rows = arrow_tokens.read_documents(spark, arrow_tokens.write_tokens(docs, shared_folder(spark), WORDS, end_id=1, length=2)).orderBy("part", "start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(None, 2), (3, 2), (3, 2), (3, 3)]


@pytest.mark.parametrize("max_words", [8_000_000, 20])
def test_word_table(spark, max_words):
    docs = table(spark)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_words.word_round_trip(docs, WORDS, max_words).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in enumerate(TEXTS):
        own = ids(WORDS, text)
        assert got[100 - i] == (len(own), sha(" ".join(map(str, own))), sha(LIBRARY[WORDS].decode(own, skip_special_tokens=False)))
    assert len(got) == len(TEXTS) and bpe_words.word_round_trip(docs.limit(0), WORDS).count() == 0


def test_blocks_beyond_their_numbers_are_an_error(monkeypatch):
    monkeypatch.setattr(bpe_words, "BLOCKS_OF_PART", 2)
    monkeypatch.setattr(bpe_words.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    batch = lambda n: [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["a b c"]}) for i in range(n)]
    read = lambda n: [(number, [len(p[0]) for p in parts]) for number, parts in bpe_words._blocks(iter(batch(n)), bpe_words.encoder(WORDS), 1)]
    assert read(2) == [(6, [1]), (7, [1])]
    with pytest.raises(ValueError, match="more than 2 blocks"):
        read(3)
