"""FLAC round trips, the toxicity model on held-out rows, and the pipeline."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tracewright.llm import flac, queries, toxicity


def padded(data):
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=3000), st.text(max_size=900).map(lambda t: (t * 5).encode("utf-8", "ignore")), st.integers(0, 255).map(lambda b: bytes([b]) * 1500)), min_size=1, max_size=4))
def test_streams_are_lossless(payloads):
    payloads = [padded(p) for p in payloads]
    got = flac.decode(flac.encode(payloads))
    assert [pcm for pcm, _ in got] == payloads
    assert [starts for _, starts in got] == [list(range(0, len(p), flac.BLOCK)) for p in payloads]


def test_all_kinds_of_frames():
    rng = np.random.default_rng(1)
    slow = (128 + 90 * np.sin(np.arange(4096) / 30) + rng.normal(0, 2, 4096)).astype(np.uint8).tobytes()
    text = ("the words of a text, and more of them " * 60).encode()
    payloads = [padded(x) for x in (slow, text, b"a" * 2000, rng.integers(0, 256, 3000, dtype=np.uint8).tobytes(), b"", b"q" * 1023 + b"\xff" * 1200)]
    streams = flac.encode(payloads)
    assert [p for p, _ in flac.decode(streams)] == payloads
    kinds = set()
    for s in streams:
        _, _, points, first = flac._metadata(s)
        for p in points:
            frame = s[first + p[1] :]
            kinds.add(frame[flac._frame(frame)[1]] >> 1)
    assert {0, 1, 31 + flac.ORDER} <= kinds and kinds & {8, 9}
    assert len(streams[0]) < 0.8 * len(payloads[0])


@pytest.mark.parametrize("number", [0, 127, 128, 2047, 2048, 65535, 65536, 1 << 21])
def test_frame_numbers(number):
    head = flac.frame_header(number, 1024)
    if number < 0x110000 and not 0xD800 <= number < 0xE000:
        assert head[4:-1] == chr(number).encode()
    assert flac._frame(head) == (1024, len(head))


def test_partitions_and_higher_orders_are_read():
    """A frame put together bit by bit: fixed order 2, two Rice partitions, a long quotient."""
    x = np.array([3, 5, 8, 12, 17, 23, 30, 38, 47, 57, 68, 80, 93, 107, 122, -60], np.int64)
    rest = np.zeros(16, np.int64)
    rest[2:] = x[2:] - 2 * x[1:-1] + x[:-2]
    bits = f"{0x0A << 1:08b}" + "".join(f"{v & 0xFF:08b}" for v in x[:2].tolist()) + "00" + "0001"
    for part, k in ((rest[2:8], 1), (rest[8:], 0)):
        bits += f"{k:04b}"
        for r in part.tolist():
            u = 2 * r if r >= 0 else -2 * r - 1
            bits += "0" * (u >> k) + "1" + (f"{u & ((1 << k) - 1):0{k}b}" if k else "")
    bits += "0" * (-len(bits) % 8)
    frame = flac.frame_header(0, 16) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    data = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(data, np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    assert np.frombuffer(flac.decode_frames([frame])[0], np.uint8).astype(np.int64).tolist() == (x + 128).tolist()


def test_damage_is_seen():
    stream = flac.encode([padded(b"some words to keep " * 200)])[0]
    for at in (len(stream) - 5, len(stream) // 2, 30):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    assert struct.unpack(">H", stream[8:10])[0] == flac.BLOCK


def test_media_columns(spark):
    texts = ["", None, "é" * 40, "word " * 30_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, b"m", "p") for i, t in enumerate(texts)], "doc_id long, text string, media binary, payload string")
    rows = {r["doc_id"]: r for r in flac.decode_media(flac.encode_media(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert rows[i]["n_bytes"] == len(data) and bytes(rows[i]["pcm"]) == padded(data)
    assert rows[4]["media"] == rows[5]["media"] and rows[0]["feature"] == rows[1]["feature"]
    assert flac.decode_media(flac.encode_media(docs.limit(0))).count() == 0


def chatter(rng, n, rude):
    words = ["".join(rng.choice(["an", "er", "tion", "ou", "the", "is", "ly"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for _ in range(2 + n // 40 if rude else 0):
        words.insert(rng.randrange(len(words) + 1), rng.choice(["grumbo", "wexfool", "snarkle"]) + rng.choice(["", "s", "x", "ing"]))
    return " ".join(words)


def labelled(n=700):
    rng = random.Random(8)
    rows = [(i, chatter(rng, rng.randrange(5, 200), i % 5 == 1), int(i % 5 == 1)) for i in range(n)]
    return rows + [(n, "", 0), (n + 1, None, 0), (n + 2, "word " * 50_000, 0), (None, "no id", 1)]


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, 9, 0.5) for i, t, _ in rows], "doc_id long, text string, toxic int, score double").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(-5, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in rows}
    known = [r for r in got if r["doc_id"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in known)
    out = [r for r in known if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(*model)
    unseen, mild = scorer.scores(["the is grumbolo ou wexfoolish an", "the is an ou lyou an"])
    assert unseen > 0.5 > mild


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = labelled(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    one, two = (spark.createDataFrame([(i, y if not held(i) else flip) for i, _, y in rows], "doc_id long, toxic int") for flip in (0, 1))
    a, b = toxicity.fit(docs, one), toxicity.fit(docs, two)
    assert a[2] == b[2] and (a[0] == b[0]).all() and (a[1] == b[1]).all()
    nothing = toxicity.judge(docs, one.limit(0))
    assert {r["score"] for r in nothing.collect()} == {0.5} and toxicity.judge(docs.limit(0), one).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(5)
    rows, menu = [], "home | about | contact"
    for i in range(240):
        body = chatter(rng, 60, i % 5 == 1)
        rows.append((i, f"{menu}\n{body}" if i % 3 == 0 else body, "en", "s", 1))
    rows += [(1000 + i, rows[2][1] + (" end" if i % 2 else ""), "en", "t", 1) for i in range(20)]
    rows += [(2000, None, "en", "s", None), (2001, "", None, None, 0), (2002, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, names = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at = at.cache()
        names.append({r["doc_id"]: r["text"] for r in at.collect()})
    clean, lined, single = names
    assert sum(i % 5 == 1 for i in clean if i < 240) <= 2 and sum(i % 5 != 1 for i in clean if i < 240) >= 190
    assert all(menu not in (t or "") for t in lined.values()) and set(lined) == set(clean)
    assert 2 in single and not any(1000 <= i < 1020 for i in single) and {2000, 2001, 2002} <= set(single)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(single)


def test_every_operator_has_a_query():
    assert [any(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [True] * 10
    assert len(hashlib.sha256(b"").hexdigest()) == 64


def test_media_is_stored_and_read_back(spark, tmp_path, monkeypatch):
    texts = ["stored and read", "", None, "é" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, decode_media = [], flac.decode_media
    monkeypatch.setattr(flac, "decode_media", lambda media: seen.append(media) or decode_media(media))
    got = {r["doc_id"]: r for r in queries.op4_flac_media(spark, str(tmp_path)).collect()}
    files = seen[0].inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
    stored = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(*files).collect()}
    assert len(got) == len(stored) == 4
    for i, stream in stored.items():
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
