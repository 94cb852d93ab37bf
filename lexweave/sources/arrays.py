"""Texts as arrays of code points: what the formats' readers and writers are made of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import FULL, NARROW

_NORM = np.arange(0x110000, dtype=np.uint32)
_NORM[[ord(c) for c in NARROW]] = [ord(c) for c in FULL]
#: White space of a line, and the line's end.
_BLANK = np.zeros(0x110000, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def whole(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _raw(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """(bytes, bounds) of texts, null as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return b"", np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (bytes(data[int(at[0]) : int(at[-1])]) if data else b""), at - at[0]


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points one after another, bounds)."""
    data, at = _raw(texts)
    flat = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    if len(flat) < len(data):
        seen = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        at = seen[at]
    return flat, at


def strings(flat: np.ndarray, bounds: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Texts of code points; ``mask``: which are null."""
    data = flat.astype(np.uint32, copy=False).tobytes().decode("utf-32-le").encode()
    if len(data) > len(flat):
        size = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
        bounds = np.concatenate([[0], np.cumsum(size)])[bounds]
    out = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(data))
    return out if mask is None or not mask.any() else pc.if_else(pa.array(mask), pa.scalar(None, pa.string()), out)


def normal(texts: pa.Array) -> pa.Array:
    """The texts' normal forms."""
    flat, bounds = points(texts)
    return strings(_NORM[flat], bounds)


def normal_points(flat: np.ndarray) -> np.ndarray:
    return _NORM[flat]


def cut(counts: np.ndarray) -> np.ndarray:
    """Bounds of parts of these sizes."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def lists(bounds: np.ndarray, values: pa.Array | np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    mask = pa.array(mask) if mask is not None and mask.any() else None
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values, mask=mask)


def flattened(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, how many of each row) of lists; null lists are empty."""
    return a.flatten(), a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def split(texts: pa.Array, by: str, empty: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(parts, bounds of each text's); without ``empty`` parts they are left out."""
    parts, many = flattened(pc.split_pattern(pc.fill_null(texts, ""), by))
    bounds = cut(many)
    if not empty:
        full = pc.not_equal(parts, "").to_numpy(zero_copy_only=False)
        parts, bounds = parts.filter(pa.array(full)), cut(full)[bounds]
    return parts, bounds


def joined(texts: pa.Array, bounds: np.ndarray, by: str = "") -> pa.Array:
    return pc.binary_join(lists(bounds, texts), by)


def lengths(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def interleave(flat: np.ndarray, bounds: np.ndarray, marks: np.ndarray, special: str = "") -> pa.Array:
    """Each character, a backslash before special ones, with the mark after it; 0 is no mark."""
    escaped = np.isin(flat, np.array([ord(c) for c in special], np.uint32)) if special else np.zeros(len(flat), bool)
    size = 1 + escaped + (marks > 0)
    end = cut(size)
    out = np.empty(end[-1], np.uint32)
    out[end[:-1][escaped]] = ord("\\")
    out[end[:-1] + escaped] = flat
    marked = marks > 0
    out[end[1:][marked] - 1] = marks[marked]
    return strings(out, end[bounds])


def marked(words: pa.Array, rule, special: str, by_word: bool = False) -> pa.Array:
    """Words (lists of texts) with a mark after each character: ``rule(code points, last of word, last of line)``."""
    parts, many = flattened(words)
    flat, at = points(parts)
    line = at[cut(many)]
    ends, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    ends[at[1:][at[1:] > at[:-1]] - 1] = True
    last[line[1:][line[1:] > line[:-1]] - 1] = True
    marks = rule(flat, ends, last).astype(np.uint32)
    return lists(cut(many), interleave(flat, at, marks, special)) if by_word else interleave(flat, line, marks, special)


def gold_rows(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """(id, line_no, words, surface, norm) of the texts' lines that hold a word."""
    flat, bounds = points(texts)
    ends = cut(flat == 10)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(~_BLANK[flat])
    text = text[at]
    line = ends[:-1][at] + text
    first = np.ones(len(at), bool)
    first[1:] = line[1:] != line[:-1]
    head = first.copy()
    head[1:] |= at[1:] != at[:-1] + 1
    rows, words = np.flatnonzero(first), np.flatnonzero(head)
    kept, size = flat[at], len(at)
    number = ends[:-1][at[rows]] - ends[bounds[:-1]][text[rows]]
    row_bounds, word_bounds = np.append(rows, size), np.append(words, size)
    return [
        ids.take(pa.array(text[rows])), pa.array(number.astype(np.int32)),
        lists(np.append(np.searchsorted(words, rows), len(words)), strings(kept, word_bounds)),
        strings(kept, row_bounds), strings(_NORM[kept], row_bounds),
    ]
