"""Words, rolling hashes and sliding minima over the UTF-8 bytes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; the arrays over them take about 50 times as much.
CHUNK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def text_chunks(column: pa.Array, limit: int = CHUNK, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; null counts as empty, a longer text is a run of its own."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    n = len(arr)
    if not n:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; only those of an ordinary chunk are kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK + 1), base, np.uint64)
        x[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(x)
        if len(have) == CHUNK + 1:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def byte_values(fold_case: bool) -> np.ndarray:
    """A 64-bit value for each byte; A-Z get those of a-z if case is folded."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    if fold_case:
        values[65:91] = values[97:123]
    return values


_FOLDED, _PLAIN = byte_values(True), byte_values(False)


def prefix_hash(buf: np.ndarray, fold_case: bool) -> np.ndarray:
    """H with H[j] - H[i] = sum of value(byte k) * P**k for i <= k < j."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    x = (_FOLDED if fold_case else _PLAIN)[buf]
    x *= powers(_P, len(buf))
    np.cumsum(x, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes [lo, hi), the same wherever they stand."""
    return mix((prefix[hi] - prefix[lo]) * powers(_P_INV, len(prefix))[lo])


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each text, and the number of words before each text."""
    n = len(buf)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = edge[:n].copy()
    first[1:] |= ~inside[:-1]
    first[0] = True
    last = edge[1:].copy()
    last[:-1] |= ~inside[1:]
    last[-1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each case-folded word, and the number of words before each text."""
    starts, ends, before = word_spans(buf, offsets, is_word)
    if not len(starts):
        return np.empty(0, np.uint64), before
    return span_hash(prefix_hash(buf, True), starts, ends), before


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, runs across texts included."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    scale = 1
    for j in range(n):
        scale = scale * _P % (1 << 64)
        out += words[j : j + m] * np.uint64(scale)
    return mix(out)


def inside_text(before: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of the first m runs of n units lie in one text."""
    ok = np.ones(m, bool)
    for j in range(1, n):
        at = before[1:-1] - j
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring values."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def byte_set(*ranges: tuple[int, int], outside: bool) -> np.ndarray:
    """A mask over byte values: those in the ranges, or all others."""
    mask = np.zeros(256, bool)
    for lo, hi in ranges:
        mask[lo : hi + 1] = True
    return ~mask if outside else mask


#: Letters, digits and every non-ASCII byte; bytes that are not white space.
LETTERS_DIGITS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F), outside=True)
NOT_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D), outside=True)
