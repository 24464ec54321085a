"""64-bit values of words, made for whole runs of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .anchors import BYTE_VALUES, Rolling
from .common import WORD_SPACE
from .dealing import mix, runs_of

_SPACE = np.isin(np.arange(256), np.frombuffer(WORD_SPACE.encode(), np.uint8))
#: Longer words are hashed one by one: a polynomial alone has short known collisions of some 1000 bytes.
_LONG = 48
#: Two independent kinds of values: byte values, base and seed.
_KINDS = (
    (BYTE_VALUES, 0x9E3779B97F4A7C15, 0),
    (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), 0xD1342543DE82EF95, 1),
)


def _bytes(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a space after each, and where each begins (and the end)."""
    return b" ".join([*texts, b""]), np.cumsum([0, *(len(t) + 1 for t in texts)])


def word_values(texts: list[bytes], *kinds: int) -> tuple[np.ndarray, ...]:
    """A value of each of ``kinds`` (0 if none is given) for every word of all texts, and, last, the
    number of words before each text (and of all)."""
    data, begin = _bytes(texts)
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.r_[word, False] != np.r_[False, word])
    start, size = edge[::2], edge[1::2] - edge[::2]
    out = []
    for values, base, seed in (_KINDS[k] for k in kinds or (0,)):
        found = Rolling(values[raw], base).at(start, size)
        for i in np.flatnonzero(size > _LONG).tolist():
            found[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]], seed)
        out.append(found)
    return *out, np.searchsorted(start, begin)


def byte_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A value for every byte of all texts, and where each text begins (and the end)."""
    return BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0, *map(len, texts)])


def windows(bounds: np.ndarray, doc: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among all symbols, document number, start) of every window of the runs (doc, p, n)."""
    start = runs_of(p, n)
    doc = np.repeat(doc, n)
    return start + bounds[doc], doc, start
