"""Sets of hashed word shingles, computed on the bytes of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Fixed odd multipliers: bytes within a word, words within a shingle. The inverse is modulo 2**64.
BYTE_STEP = 0x9E3779B97F4A7C15
WORD_STEP = 0xD1342543DE82EF95
BYTE_BACK = pow(BYTE_STEP, -1, 1 << 64)
#: Fixed random value of each byte.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 19


def _powers(base: int, size: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; the first are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < size:
        steps = np.full(max(size, 8), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    Words are runs of anything but space and the controls 9-13, with A-Z
    lower-cased. A text of fewer words than `size` has one shingle, of all its
    words; one without words has none.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = LOWER[np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)]
    word = ~SPACE[buffer]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    # sums of value * step**i up to each byte; a word's own sum, shifted back to its start, doesn't depend on where it stands
    total = np.cumsum(BYTE_VALUE[buffer] * _powers(BYTE_STEP, len(buffer)), dtype=np.uint64)
    own = mix((total[stop - 1] - total[start - 1]) * _powers(BYTE_BACK, len(buffer))[start]) if len(start) else np.empty(0, np.uint64)
    ends = np.cumsum([len(d) + 1 for d in data]) + 1
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    last = np.searchsorted(start, ends)
    steps = _powers(WORD_STEP, size)
    whole = max(0, len(own) - size + 1)
    rolled = np.zeros(whole, np.uint64)
    for i in range(size):
        rolled += own[i : i + whole] * steps[i]
    rolled = mix(rolled)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield mix(np.array([(own[a:b] * steps[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
