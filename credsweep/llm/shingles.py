"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Bytes hashed at a time; a longer text is cut at white space and its words put together again.
CHUNK = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Powers of the base for the places within a word; they repeat after 65,536 bytes, turned by the round.
_POWERS = np.cumprod(np.full(1 << 16, _BASE, np.uint64))
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA5A3564E27F88697, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some bytes, and where each word starts.

    Words are runs of anything but the six white-space bytes, lower-casing is of
    A-Z only; a word also ends at each of ``breaks``.
    """
    space = _IS_SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    word = np.cumsum(first) - 1
    at = np.arange(len(raw)) - starts[np.maximum(word, 0)]
    value = _BYTE[_LOWER[raw]] * _POWERS[at & 0xFFFF]
    if at.max(initial=0) > 0xFFFF:
        value *= mix((at >> 16).astype(np.uint64)) | np.uint64(1)
    value[space] = 0
    return mix(np.add.reduceat(value, starts)), starts


def pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text cut at white space into pieces of about CHUNK bytes."""
    a = 0
    while a < len(raw):
        b = min(a + CHUNK, len(raw))
        while b < len(raw) and not _IS_SPACE[raw[b]]:
            more = np.flatnonzero(_IS_SPACE[raw[b:b + CHUNK]])
            b = b + int(more[0]) if len(more) else min(b + CHUNK, len(raw))
        yield raw[a:b]
        a = b


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of fewer words, the whole sequence as one; none for none."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        out = np.array([np.uint64(n)])
        for j in range(n):
            out = out + words[j:j + 1] * _STEP[j]
        return mix(out)
    out = words[:n - size + 1] * _STEP[0]
    for j in range(1, size):
        out = out + words[j:n - size + 1 + j] * _STEP[j % 8] * (np.uint64(2 * (j // 8)) + np.uint64(1))
    return mix(out)


def texts_words(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a string column the hashes of its words in order; null has none."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        if j == i + 1 and offsets[j] - offsets[i] > CHUNK:
            yield np.concatenate([word_hashes(p, np.zeros(0, int))[0] for p in pieces(data[offsets[i]:offsets[j]])])
        else:
            inner = offsets[i:j + 1] - offsets[i]
            words, starts = word_hashes(data[offsets[i]:offsets[j]], inner[1:-1])
            bounds = np.searchsorted(starts, inner)
            for k in range(j - i):
                yield words[bounds[k]:bounds[k + 1]]
        i = j


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for words in texts_words(column):
        yield np.unique(shingle_hashes(words, size))


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    total = int(mix(shingles).sum(dtype=np.uint64)) if len(shingles) else 0
    out = int(mix(np.array([(total + 0x9E3779B97F4A7C15 * len(shingles)) & MASK], np.uint64))[0])
    return out - (1 << 64) if out >= 1 << 63 else out
