"""Sets of word shingles, computed for many texts at once on their UTF-8 bytes.

Words are maximal runs of bytes other than space and \\x09-\\x0D; A-Z count as a-z. A set holds 64-bit
hashes of its ``k``-word shingles. A text of fewer words (but at least one) has its whole word sequence
as the only shingle; a null, empty or blank text has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += U(32)
_LOWER += U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER[_SPACE] = U(0)
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(64, _BASE), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _BASE), dtype=np.uint64)
    return _powers


def pieces_of(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (first row, next row, bytes, row offsets into them) of at most ``most`` bytes, or one text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and how many words each row has."""
    rows = len(offsets) - 1
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    starts[edge] = ~space[edge]
    first = np.flatnonzero(starts)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    at = np.arange(len(data), dtype=np.int64)
    place = at - np.maximum.accumulate(np.where(starts, at, 0))
    place[space] = 0
    value = _LOWER[data] * _power(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(value, first)), np.diff(np.searchsorted(first, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and the size of each set."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    begins = ends - counts
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | U(1)
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        whole += words[j : j + len(whole)] * weights[j]
    whole = mix(whole)
    flat = np.empty(int(sizes.sum()), np.uint64)
    kept = np.zeros(len(sizes), np.int64)
    at = 0
    for i, (b, n, size) in enumerate(zip(begins.tolist(), counts.tolist(), sizes.tolist(), strict=True)):
        if not size:
            continue
        if n < k:
            own = (words[b : b + n] * weights[:n]).sum(dtype=np.uint64, keepdims=True)
            flat[at] = mix(own ^ U(0xD6E8FEB86659FD93 + n))[0]
            kept[i], at = 1, at + 1
            continue
        own = np.sort(whole[b : b + size])
        if (same := own[1:] == own[:-1]).any():
            own = own[np.append(True, ~same)]
        flat[at : at + len(own)] = own
        kept[i], at = len(own), at + len(own)
    return flat[:at], kept


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (first row, next row, flat sets, sizes) over all rows of ``texts``."""
    for at, end, data, offsets in pieces_of(texts):
        yield at, end, *shingle_sets(data, offsets, k)


def prints(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; equal sets have equal ones. Zero for the empty set."""
    begins = np.cumsum(sizes) - sizes
    out = []
    full = sizes > 0
    for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
        part = np.zeros(len(sizes), np.uint64)
        if full.any():
            part[full] = mix(np.add.reduceat(mix(flat ^ U(salt)), begins[full]) + sizes[full].astype(np.uint64))
        out.append(part)
    return out[0], out[1]
