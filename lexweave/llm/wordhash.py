"""Vectorised word splitting and hashing over the bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Word bytes: ASCII letters and digits, and all of a non-ASCII character that isn't a sign.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def relax() -> None:
    """Give freed memory back to the machine: a worker waits between tasks with what it has."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _PINV)):
            a = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gap, alone): at first bytes of separators, and of characters that are words alone, the length in bytes; else 0.

    By UTF-8's first bytes: Latin-1 signs (C2, and the signs for times and
    division), the general punctuation and symbols of U+2000 to U+2BFF, ideographic
    punctuation, and full-width signs separate. Kana, ideographs and the letters of
    Thai, Lao, Myanmar and Khmer, which are written without blanks, are words alone.
    """
    pad = np.zeros(2, np.uint8)
    a, b, c = data, np.concatenate([data[1:], pad[:1]]), np.concatenate([data[2:], pad])
    e2, e3, ef, f0 = a == 0xE2, a == 0xE3, a == 0xEF, a == 0xF0
    two = ((a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA))) | ((a == 0xC3) & np.isin(b, (0x97, 0xB7)))
    mark = e3 & (b == 0x80) & ~((c >= 0x85) & (c <= 0x87))
    wide = ef & ((b == 0xBC) & ((c <= 0x8F) | ((c >= 0x9A) & (c <= 0xA0)) | (c >= 0xBB)) | (b == 0xBD) & ((c >= 0x9B) & (c <= 0xA5)))
    three = (e2 & (b <= 0xAF)) | mark | wide
    gap = two * np.int8(2) + three * np.int8(3)
    alone3 = (e3 & ~mark) | ((a >= 0xE4) & (a <= 0xE9)) | (ef & (b >= 0xA4) & (b <= 0xAB)) | (ef & ((b == 0xBD) & (c >= 0xA6) | (b == 0xBE) & (c <= 0x9F))) | ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & np.isin(b, (0x80, 0x81, 0x82, 0x9E, 0x9F)))
    alone = alone3 * np.int8(3) + (f0 & (b >= 0xA0) & (b <= 0xBF)) * np.int8(4)
    return gap, alone


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each word; a word doesn't run over the end of its row.

    A word is a run of letters and digits; a character of a script without blanks is one.
    """
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = table[data]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    high = np.flatnonzero(data >= 0xC2)
    high = high[(data[high] != 0xC3) | np.isin(data[np.minimum(high + 1, len(data) - 1)], (0x97, 0xB7))] if len(high) else high
    if len(high):
        # only the bytes around those first bytes are looked at
        near = np.stack([data[np.minimum(high + k, len(data) - 1)] for k in range(3)])
        gap, alone = (x[::3] for x in _classes(near.T.ravel()))
        for k in range(3):
            at = high[gap > k] + k
            flags[1 + at[at < len(data)]] = 0
        one = alone > 0
        cuts = np.unique(np.concatenate([cuts, high[one], high[one] + alone[one]]))
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
    edge = np.diff(flags)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(cuts):
        # the end of a row and a word of one character break a run
        cuts = cuts[(flags[cuts] == 1) & (flags[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    row = np.searchsorted(offsets, starts, "right") - 1
    return row, starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, equal for equal bytes."""
    pw, inv = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


def hash_word(word: str) -> int:
    """The hash that span_hashes gives to this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])
