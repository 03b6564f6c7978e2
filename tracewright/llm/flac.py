"""Lossless media columns: 8-bit PCM in FLAC streams, written and read in batches of frames."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pieces import in_blocks

BLOCK = 2048
RATE = 8000
#: Order, coefficient bits and shift of the written linear predictors.
ORDER, PRECISION, SHIFT = 4, 10, 8
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
#: Frames that are coded or decoded together.
GROUP = 1024


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, table = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly) & mask if value & top else (value << 1) & mask
        table.append(value)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), np.array(_crc_table(0x8005, 16), np.uint16)
_FAR = CRC16[None, :]


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = CRC8[value ^ byte]
    return value


def crc16(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of slices that follow one another: the remainder is linear, so each byte adds what it is worth at its distance from the end."""
    global _FAR
    while len(_FAR) < size.max():
        last = _FAR[-1]
        more = [last := CRC16[last >> 8] ^ (last << np.uint16(8)) for _ in range(len(_FAR))]
        _FAR = np.concatenate([_FAR, np.stack(more)])
    distance = np.repeat(start + size, size) - 1 - np.arange(len(buffer))
    return np.bitwise_xor.reduceat(_FAR[distance, buffer], start)


@lru_cache(1 << 14)
def frame_header(number: int, size: int) -> bytes:
    """Fixed block size, mono, 8 bits."""
    code = {256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + chr(number).encode() if number < 0x800 else bytes([0xFF, 0xF8, code << 4, 0x02]) + _long_number(number)
    head += struct.pack(">H", size - 1) if code == 7 else b""
    return head + bytes([crc8(head)])


def _long_number(number: int) -> bytes:
    """UTF-8's scheme, carried on to 36 bits."""
    more = next(n for n in range(2, 7) if number < 1 << (5 * n + 6))
    tail = bytes(0x80 | (number >> 6 * i) & 0x3F for i in reversed(range(more)))
    return bytes([(0xFF << (7 - more)) & 0xFF | number >> 6 * more]) + tail


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each row, from its autocorrelation."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(axis=1) for lag in range(ORDER + 1)], axis=1)
    error, a = r[:, 0] * (1 + 1e-9) + 1e-9, np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = error * (1 - k * k) + 1e-9
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -limit, limit - 1).astype(np.int32)


def _rice(u: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the Rice parameter and the bits; no quotient beyond 40, so that a code fits a window of the reader."""
    mean = u.sum(axis=1) / np.maximum(count, 1)
    floor = np.ceil(np.log2(np.maximum(u.max(axis=1), 1) / 40)).astype(np.int32)
    best, bits = None, None
    for shift in (0, 1):
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int32) + shift, np.maximum(floor, 0), 14)
        size = (u >> k[:, None]).sum(axis=1) + count * (k + 1)
        best, bits = (k, size) if best is None else (np.where(size < bits, k, best), np.minimum(size, bits))
    return best, bits


def encode_frames(x: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The subframe of each row of samples, `size` of them; rows are padded with 0."""
    rows, width = x.shape
    column = np.arange(width)
    live = column < size[:, None]
    coefficient = _predictors(x)
    r1 = np.zeros_like(x)
    r1[:, 1:] = x[:, 1:] - x[:, :-1]
    lpc = np.zeros_like(x)
    for j in range(ORDER):
        lpc[:, ORDER:] += coefficient[:, j : j + 1] * x[:, ORDER - 1 - j : width - 1 - j]
    lpc = x - (lpc >> SHIFT)
    options = []
    for order, residual, head in ((0, x, 18), (1, r1, 26), (ORDER, lpc, 18 + 8 * ORDER + 9 + PRECISION * ORDER)):
        u = np.where(live & (column >= order), _zigzag(residual), 0)
        k, bits = _rice(u, np.maximum(size - order, 0))
        options.append((order, u, k, bits + head))
    choice = np.argmin(np.stack([o[3] for o in options]), axis=0)
    bits = np.min(np.stack([o[3] for o in options]), axis=0)
    raw = (x + 128).astype(np.uint8)
    same = (np.where(live, x, x[:, :1]) == x[:, :1]).all(axis=1)
    plain = (bits >= 8 + 8 * size) | (size <= ORDER)
    out: list[bytes] = [b""] * rows
    for i in np.flatnonzero(same | plain).tolist():
        own = (x[i, : size[i]]).astype(np.int8).tobytes()
        out[i] = b"\x00" + own[:1] if same[i] else b"\x02" + own
    coded = np.flatnonzero(~(same | plain))
    if not len(coded):
        return out
    choice, bits, n = choice[coded], bits[coded].astype(np.int64), size[coded]
    order = np.array([0, 1, ORDER])[choice]
    k = np.select([choice == i for i in range(3)], [o[2][coded] for o in options]).astype(np.int64)
    area = (bits + 7) // 8 * 8
    base = np.cumsum(area) - area
    stream = np.zeros(int(area.sum()), np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            stream[at + b] = (value >> (width - 1 - b)) & 1

    put(base, np.where(order == ORDER, 0x40 | (ORDER - 1) << 1, 0x10 | order << 1), 8)
    at = base + 8
    for i in range(ORDER):
        some = order > i
        put(at[some], x[coded[some], i].astype(np.int64) & 0xFF, 8)
        at = at + 8 * some
    some = order == ORDER
    put(at[some], np.full(some.sum(), (PRECISION - 1) << 5 | SHIFT), 9)
    at = at + 9 * some
    for j in range(ORDER):
        put(at[some], coefficient[coded[some], j].astype(np.int64) & ((1 << PRECISION) - 1), PRECISION)
        at = at + PRECISION * some
    put(at, k, 10)
    at = at + 10
    valid = (column < n[:, None]) & (column >= order[:, None])
    u = np.select([(choice == i)[:, None] for i in range(3)], [o[1][coded] for o in options])[valid].astype(np.int64)
    count = n - order
    each = np.repeat(k, count)
    quotient = u >> each
    length = quotient + 1 + each
    before = np.cumsum(length) - length
    first = np.cumsum(count) - count
    place = before + np.repeat(at - before[first], count) + quotient
    stream[place] = 1
    for b in range(int(k.max())):
        have = each > b
        stream[place[have] + 1 + b] = (u[have] >> (each[have] - 1 - b)) & 1
    packed = np.packbits(stream)
    for i, a, m in zip(coded.tolist(), (base // 8).tolist(), (area // 8).tolist()):
        out[i] = packed[a : a + m].tobytes()
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 64 bytes: with the MD5 of the samples and a seek point for every frame."""
    frames = [(d, i) for d, p in enumerate(payloads) for i in range(0, len(p), BLOCK)]
    bodies: list[list[bytes]] = [[] for _ in payloads]
    for g in range(0, len(frames), GROUP):
        part = frames[g : g + GROUP]
        x, size = np.zeros((len(part), BLOCK), np.int32), np.zeros(len(part), np.int64)
        for row, (d, i) in enumerate(part):
            own = np.frombuffer(payloads[d], np.uint8, min(BLOCK, len(payloads[d]) - i), i)
            x[row, : len(own)], size[row] = own, len(own)
            x[row, : len(own)] -= 128
        made = [frame_header(i // BLOCK, int(n)) + body for (_, i), n, body in zip(part, size, encode_frames(x, size))]
        lengths = np.array([len(m) for m in made])
        sums = crc16(np.frombuffer(b"".join(made), np.uint8), np.cumsum(lengths) - lengths, lengths)
        for (d, _), m, s in zip(part, made, sums.tolist()):
            bodies[d].append(m + s.to_bytes(2, "big"))
    out = []
    for payload, own in zip(payloads, bodies):
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        sizes = [len(b) for b in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, at = [], 0
        for i, b in enumerate(sizes):
            points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(payload) - i * BLOCK)))
            at += b
        seek = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


def _metadata(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(samples, md5, seek points, place of the first frame)."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, points, total, digest, last = 4, [], 0, b"", False
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 36 & 0xFF != 7:
                raise ValueError("only mono streams of 8 bits are read")
            total, digest = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    return total, digest, points, at


def _frame(data: bytes) -> tuple[int, int]:
    """(samples, place of the subframe) of a frame whose header checks."""
    if data[0] != 0xFF or data[1] != 0xF8:
        raise ValueError("no frame of a fixed block size")
    code, at = data[2] >> 4, 5
    lead = data[4]
    while lead & 0x80 and lead & 0x40:
        lead, at = lead << 1 & 0xFF, at + 1
    if code in (6, 7):
        size = int.from_bytes(data[at : at + code - 5], "big") + 1
        at += code - 5
    else:
        size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    if crc8(data[:at]) != data[at]:
        raise ValueError("the checksum of a frame header is wrong")
    return size, at + 1


LEADING = np.array([16] + [15 - int(np.log2(i)) for i in range(1, 1 << 16)], np.int64)


def decode_frames(frames: list[bytes]) -> list[bytes]:
    """The 8-bit PCM of each frame, after its checksums."""
    lengths = np.array([len(f) for f in frames])
    start = np.cumsum(lengths) - lengths
    buffer = np.frombuffer(b"".join(frames), np.uint8)
    if crc16(buffer, start, lengths).any():  # over its own checksum a frame's is 0
        raise ValueError("the checksum of a frame is wrong")
    heads = [_frame(f) for f in frames]
    out: list[bytes] = [b""] * len(frames)
    coded = []
    for i, (frame, (size, at)) in enumerate(zip(frames, heads)):
        kind = frame[at] >> 1
        if frame[at] & 0x81:
            raise ValueError("wasted bits are not read")
        if kind == 0:
            out[i] = frame[at + 1 : at + 2] * size
        elif kind == 1:
            out[i] = frame[at + 1 : at + 1 + size]
        elif 8 <= kind <= 12 or kind >= 32:
            coded.append((size, i, kind - 8 if kind < 32 else kind - 31, kind >= 32, int(start[i]) + at + 1))
        else:
            raise ValueError("unknown subframe")
    if coded:
        # the longest first, so that the frames that go on are a prefix
        coded.sort(key=lambda c: (-c[0], c[1]))
        x = _decode_coded(buffer, coded)
        for column, (size, i, _, _, _) in enumerate(coded):
            out[i] = x[:size, column].astype(np.int8).tobytes()
    return [(np.frombuffer(o, np.uint8) ^ 0x80).tobytes() for o in out]


def _decode_coded(buffer: np.ndarray, coded: list[tuple]) -> np.ndarray:
    """Samples (time, frame) of fixed and linear predictors: all frames go forward one sample at a time."""
    padded = np.concatenate([buffer, np.zeros(16, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(buffer) + 8, np.uint64)
    for j in range(8):
        window |= padded[j : j + len(window)] << np.uint64(56 - 8 * j)

    def peek(at: np.ndarray) -> np.ndarray:
        return window[at >> 3] << (at & 7).astype(np.uint64)

    def take(at: np.ndarray, width: int) -> np.ndarray:
        return (peek(at) >> np.uint64(64 - width)).astype(np.int64)

    size, order = np.array([c[0] for c in coded]), np.array([c[2] for c in coded])
    linear = np.array([c[3] for c in coded])
    at = np.array([c[4] for c in coded]) * 8
    most = int(order.max())
    x = np.zeros((int(size[0]) + most, len(coded)), np.int64)  # `most` rows of zeros before the first sample
    coefficient, shift = np.zeros((max(most, 1), len(coded)), np.int64), np.zeros(len(coded), np.int64)
    signed = lambda v, width: v - ((v >> (width - 1)) << width)
    for i in range(most):
        some = order > i
        x[most + i, some] = signed(take(at[some], 8), 8)
        at = at + 8 * some
    for f in np.flatnonzero(~linear):
        coefficient[: order[f], f] = FIXED[int(order[f])]
    if linear.any():
        own = np.flatnonzero(linear)
        precision = take(at[own], 4) + 1
        shift[own] = take(at[own] + 4, 5)
        at[own] += 9
        for j in range(most):
            for width in np.unique(precision):
                some = own[(precision == width) & (order[own] > j)]
                coefficient[j, some] = signed(take(at[some], int(width)), int(width))
                at[some] += width
    if (take(at, 2) != 0).any():
        raise ValueError("only 4-bit Rice parameters are read")
    parts = 1 << take(at + 2, 4)
    at = at + 6
    each, k = size // parts, np.zeros(len(coded), np.int64)
    due = np.zeros(len(coded), np.int64)
    for i in range(int(size[0])):
        n = int(np.searchsorted(-size, -i, side="left"))
        live = slice(0, n)
        if i <= most or (parts[live] > 1).any():
            ready = np.flatnonzero(i >= order[live])
            new = ready[(due[ready] == i) | ((i == order[ready]) & (due[ready] == 0))]
            k[new] = take(at[new], 4)
            if (k[new] == 15).any():
                raise ValueError("escaped partitions are not read")
            at[new] += 4
            due[new] = (i // each[new] + 1) * each[new]
            if not len(ready):
                continue
        else:
            ready = live
        place = at[ready]
        word = peek(place)
        zeros = LEADING[word >> np.uint64(48)]
        quotient = zeros
        if (zeros == 16).any():
            quotient = zeros.copy()
            while (zeros == 16).any():
                more = np.flatnonzero(zeros == 16)
                zeros = np.zeros_like(zeros)
                zeros[more] = LEADING[peek(place[more] + quotient[more]) >> np.uint64(48)]
                quotient[more] += zeros[more]
        own = k[ready]
        place = place + quotient + 1
        rest = (peek(place) >> np.uint64(48)).astype(np.int64) >> (16 - own)
        at[ready] = place + own
        u = quotient << own | rest
        value = (u >> 1) ^ -(u & 1)
        if most:
            guess = coefficient[0, ready] * x[most + i - 1, ready]
            for j in range(1, most):
                guess += coefficient[j, ready] * x[most + i - 1 - j, ready]
            value += guess >> shift[ready]
        x[most + i, ready] = value
    return x[most:]


def decode(media: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """(PCM, first sample of each block) of each stream, checked by frame and by the stream's MD5."""
    frames, parts = [], []
    for d, m in enumerate(media):
        total, digest, points, first = _metadata(m)
        ends = [p[1] for p in points[1:]] + [len(m) - first]
        frames += [(d, m[first + p[1] : first + e]) for p, e in zip(points, ends)]
        parts.append((total, digest, [p[0] for p in points], []))
    for g in range(0, len(frames), GROUP):
        part = frames[g : g + GROUP]
        for (d, _), pcm in zip(part, decode_frames([f for _, f in part])):
            parts[d][3].append(pcm)
    out = []
    for total, digest, starts, blocks in parts:
        pcm = b"".join(blocks)
        if len(pcm) != total or hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()).digest() != digest:
            raise ValueError("the samples don't agree with the stream's MD5")
        out.append((pcm, starts))
    return out


def feature(pcm: bytes) -> str:
    """Level and shape of the signal: root mean square, peak, zero crossings and mean step."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    step = np.abs(np.diff(x))
    return f"rms={np.sqrt((x * x).mean()):.4f} peak={int(np.abs(x).max())} crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())} step={step.mean():.4f}"


def payload(text: Column) -> Column:
    """UTF-8 of the text with bytes 0 up to a positive multiple of 64; null is empty."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    want = F.greatest(F.lit(64), F.ceil(F.length(data) / 64) * 64).cast("int")
    return F.rpad(data, want, F.lit(b"\x00"))


def encode_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as 8-bit samples of a FLAC stream.

    A frame of 2048 samples takes the smallest of a constant, plain samples, fixed
    predictors and a linear predictor with Rice residuals. Null and empty text are 64
    samples of byte 0. Equal texts have equal streams. Frames of many documents are
    coded together, a long text in several groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in in_blocks((p.as_py() for p in batch.column("payload")), 1 << 21):
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(block)) for c in ("doc_id", "n_bytes")] + [pa.array(encode(block), pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(block)

    small_batches(docs)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), payload(F.col(text)).alias("payload"))
    return base.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """The columns of `media` and pcm, block_starts, feature: samples of the stream, where blocks begin, features of the samples.

    A frame or stream whose checksum is wrong is an error.
    """
    names = [c for c in media.columns if c not in ("pcm", "block_starts", "feature")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in in_blocks((m.as_py() for m in batch.column("media")), 1 << 21):
                found = decode(block)
                own = [batch.column(c).slice(at, len(block)) for c in names]
                made = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([feature(f[0]) for f in found])]
                yield pa.RecordBatch.from_arrays(own + made, names=[*names, "pcm", "block_starts", "feature"])
                at += len(block)

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names)
    return media.mapInArrow(run, f"{schema}, pcm binary, block_starts array<long>, feature string")
