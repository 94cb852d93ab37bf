"""Annotation formats as columns: a line to a sentence, and back.

A sentence is ``struct<surface, norm, ws_confs: array<double>, words: array<word>>``.
``ws_confs`` has a number for each place between two characters: above 0 a word
ends there, below 0 none does, 0 is unknown; annotation counts as 100. A word is
``struct<surface, norm, tags: array<array<struct<tag, score>>>, is_certain, unknown>``.

All formats are parsed and written by array, a batch of lines at once: escaped
characters are held as noncharacters (U+FDD0 on), which annotated text may not
contain, until the line has been split. A last line without a line end counts like any other.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_bytes, normalize_text
from . import arrays as A

FORMATS = {"full": "full", "tags": "tags", "tok": "tok", "part": "part", "conf": "conf", "prob": "conf", "eda": "eda", "raw": "raw"}
SURE = 100.0
TAGS = "array<array<struct<tag:string,score:double>>>"
WORD = f"struct<surface:string,norm:string,tags:{TAGS},is_certain:boolean,unknown:boolean>"
SENTENCE = f"struct<surface:string,norm:string,ws_confs:array<double>,words:array<{WORD}>>"
_SPECIAL = " /&\\|-?"
_HELD = "".join(chr(0xFDD0 + i) for i in range(len(_SPECIAL)))


def format_name(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown corpus format {name!r}: one of {', '.join(FORMATS)}")
    return FORMATS[name]


_T = {
    "tag": pa.struct([("tag", pa.string()), ("score", pa.float64())]),
    "word": pa.struct([("surface", pa.string()), ("norm", pa.string()), ("tags", pa.list_(pa.list_(pa.struct([("tag", pa.string()), ("score", pa.float64())])))), ("is_certain", pa.bool_()), ("unknown", pa.bool_())]),
}
_T["sentence"] = pa.struct([("surface", pa.string()), ("norm", pa.string()), ("ws_confs", pa.list_(pa.float64())), ("words", pa.list_(_T["word"]))])
_BACK = np.arange(0x110000, dtype=np.uint32)
_BACK[[ord(c) for c in _HELD]] = [ord(c) for c in _SPECIAL]
_HOLD = {ord(c): ord(h) for c, h in zip(_SPECIAL, _HELD)}
#: What a dot of Java's regular expressions doesn't match.
_NO_DOT = np.array([0x0A, 0x0D, 0x85, 0x2028, 0x2029], np.uint32)


def _hold(lines: pa.Array) -> pa.Array:
    """Escaped characters as noncharacters; a backslash at the end is an error. A line without backslashes is as it was."""
    flat, bounds = A.points(lines)
    slash = flat == ord("\\")
    if not slash.any():
        return pc.fill_null(lines, "")
    heads = np.zeros(len(flat) + 1, bool)
    heads[bounds] = True
    after = np.concatenate([[False], slash[:-1]]) & ~heads[:-1]
    at = np.arange(len(flat))
    # in a run of backslashes every other one escapes
    escapes = slash & ((at - np.maximum.accumulate(np.where(slash & ~after, at, 0))) % 2 == 0)
    if (open_ := escapes & heads[1:]).any():
        raise ValueError(f"nothing follows the escape: {lines[int(np.searchsorted(bounds, np.flatnonzero(open_)[0], 'right')) - 1].as_py()}")
    which = np.flatnonzero(escapes)
    which = which[~np.isin(flat[which + 1], _NO_DOT)]
    out = flat.copy()
    for c, h in _HOLD.items():
        out[which[flat[which + 1] == c] + 1] = h
    stay = np.ones(len(flat), bool)
    stay[which] = False
    return A.strings(out[stay], A.cut(stay)[bounds])


def _release(texts: pa.Array) -> pa.Array:
    flat, bounds = A.points(texts)
    return A.strings(_BACK[flat], bounds)


def _tags(slots: pa.Array, score: float = SURE) -> pa.Array:
    """Of each slot its alternatives, with the score."""
    tags, bounds = A.split(slots, "&")
    return A.lists(bounds, pa.StructArray.from_arrays([_release(tags), pa.array(np.full(len(tags), score))], ["tag", "score"]))


def _slotted(parts: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(heads, tags by level) of parts whose first is the head and whose others are slots; each has a head."""
    slot = np.ones(len(parts), bool)
    slot[bounds[:-1]] = False
    return parts.take(pa.array(bounds[:-1])), A.lists(A.cut(slot)[bounds], _tags(parts.filter(pa.array(slot))))


def _words(surface: pa.Array, tags: pa.Array | None = None, certain: np.ndarray | None = None) -> pa.Array:
    n = len(surface)
    tags = A.lists(np.zeros(n + 1, np.int64), pa.array([], _T["word"].field("tags").type.value_type)) if tags is None else tags
    return pa.StructArray.from_arrays([surface, A.normal(surface), tags, pa.array(np.ones(n, bool) if certain is None else certain), pa.array(np.zeros(n, bool))], ["surface", "norm", "tags", "is_certain", "unknown"])


def _said(words: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the words say of the places between characters: (numbers, bounds)."""
    ends = A.cut(A.lengths(words))
    out = np.full(ends[-1], -SURE)
    out[ends[1:][ends[1:] > ends[:-1]] - 1] = SURE
    line = ends[bounds]
    inner = np.ones(len(out), bool)
    inner[line[1:][line[1:] > line[:-1]] - 1] = False
    return out[inner], A.cut(inner)[line]


def _sentence(lines: pa.Array, words: pa.Array, bounds: np.ndarray, surface: pa.Array | None = None, confs: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Array:
    own = words.field("surface")
    surface = A.joined(own, bounds) if surface is None else surface
    confs = _said(own, bounds) if confs is None else confs
    parts = [surface, A.normal(surface), A.lists(confs[1], confs[0]), A.lists(bounds, words)]
    null = lines.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays(parts, ["surface", "norm", "ws_confs", "words"], mask=pa.array(null) if null.any() else None)


def _reader(kernel: Callable[[pa.Array], pa.Array]) -> Callable[..., Column]:
    """A reader of columns from one of arrays of lines; a null line is null."""

    @functools.wraps(kernel)
    def read(line: Column, *options) -> Column:
        def run(lines: pa.Array) -> pa.Array:
            return kernel(A.whole(lines).cast(pa.string()), *options)

        run.__annotations__ = {"lines": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, SENTENCE)(line)

    read.kernel = kernel
    return read


@_reader
def read_raw(lines: pa.Array) -> pa.Array:
    """Nothing is known of a raw line; nothing is escaped in it."""
    text = pc.fill_null(lines, "")
    bounds = A.cut(np.maximum(A.lengths(text) - 1, 0))
    return _sentence(lines, _words(pa.array([], pa.string())), np.zeros(len(lines) + 1, np.int64), text, (np.zeros(bounds[-1]), bounds))


@_reader
def read_tokenized(lines: pa.Array, separator: str = " ") -> pa.Array:
    words, bounds = A.split(lines, separator)
    return _sentence(lines, _words(words), bounds)


def _full(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    tokens, bounds = A.split(_hold(lines), " ")
    heads, tags = _slotted(*A.split(tokens, "/", empty=True))
    bad = pc.or_(pc.equal(heads, ""), pc.match_substring(heads, "&")).to_numpy(zero_copy_only=False)
    if bad.any():
        raise ValueError(f"no word before its tags: {_release(tokens)[int(np.flatnonzero(bad)[0])].as_py()}")
    return _words(_release(heads), tags), bounds


@_reader
def read_full(lines: pa.Array) -> pa.Array:
    """``word/tag/tag`` with ``&`` between alternatives; an empty slot is a level without a tag."""
    return _sentence(lines, *_full(lines))


_UNIT = re.compile(r"(?s)(.)(/[^|]*?(?=\||\Z))?([-| ?]|\Z)")
_MARKS = {"|": SURE, "-": -SURE}


def _odd_partial(held: str | None, line: str) -> dict | None:
    """A partial line unit by unit."""
    if held is None:
        return None
    units = list(_UNIT.finditer(held))
    if "".join(u[0] for u in units) != held:
        raise ValueError(f"a mark is out of place: {line}")
    back = lambda t: t.translate({ord(h): c for c, h in zip(_SPECIAL, _HELD)})
    words, own, sure = [], "", True
    for u in units:
        own += u[1]
        if u[3] in ("|", ""):
            slots = [[{"tag": back(t), "score": SURE} for t in slot.split("&") if t] for slot in (u[2] or "").split("/")[1:]]
            words.append({"surface": back(own), "norm": normalize_text(back(own)), "tags": slots, "is_certain": sure, "unknown": False})
            own, sure = "", True
        elif u[3] != "-":
            sure = False
    if own:
        words.append({"surface": back(own), "norm": normalize_text(back(own)), "tags": [], "is_certain": sure, "unknown": False})
    text = back("".join(u[1] for u in units))
    return {"surface": text, "norm": normalize_text(text), "ws_confs": [_MARKS.get(u[3], 0.0) for u in units][:-1], "words": words}


@_reader
def read_partial(lines: pa.Array) -> pa.Array:
    """Character, mark, character ...: ``|`` ends a word, ``-`` doesn't, a blank or ``?`` leaves it open; tags stand before ``|`` or the end."""
    held = _hold(lines)
    chunks, bounds = A.split(held, "|", empty=True)
    flat, at = A.points(chunks)
    size = np.diff(at)
    odd_place = (np.arange(len(flat)) - np.repeat(at[:-1], size)) % 2 == 1
    # a chunk is characters and marks in turn up to a slash in the place of a mark
    slash = np.flatnonzero((flat == ord("/")) & odd_place)
    owner = np.searchsorted(at, slash, "right") - 1
    head = size.copy()
    which, first = np.unique(owner, return_index=True)
    head[which] = slash[first] - at[which]
    in_head = np.arange(len(flat)) - np.repeat(at[:-1], size) < np.repeat(head, size)
    mark = odd_place & in_head
    wrong = A.cut(mark & ~np.isin(flat, np.array([ord(c) for c in "- ?"], np.uint32)))[at]
    good = (head % 2 == 1) & (wrong[1:] == wrong[:-1])
    fails = A.cut(~good)[bounds]
    empty = pc.equal(held, "").to_numpy(zero_copy_only=False)
    odd = (fails[1:] > fails[:-1]) & ~empty
    if odd.any():  # characters that look like marks, marks out of place
        rest, some = np.flatnonzero(~odd), np.flatnonzero(odd)
        slow = pa.array([_odd_partial(h if n else None, x) for h, x, n in zip(held.take(pa.array(some)).to_pylist(), lines.take(pa.array(some)).to_pylist(), lines.take(pa.array(some)).is_valid().to_pylist())], _T["sentence"])
        fast = read_partial.kernel(lines.take(pa.array(rest)))
        return pa.concat_arrays([fast.cast(_T["sentence"]), slow]).take(pa.array(np.argsort(np.concatenate([rest, some]))))
    char = in_head & ~odd_place
    live = np.repeat(head > 0, size)  # empty lines have an empty chunk
    char &= live
    ends = np.zeros(len(flat), bool)
    ends[(at[:-1] + head - 1)[head > 0]] = True
    # the mark after each character: that of the next place, or the end of its chunk
    where = np.flatnonzero(char)
    follow = np.concatenate([flat, [0]]).astype(np.uint32)[where + 1]
    confs = np.where(ends[where], SURE, np.where(follow == ord("-"), -SURE, 0.0))
    chunk_chars = A.cut(char)[at]
    line_chars = chunk_chars[bounds]
    inner = np.ones(len(where), bool)
    inner[line_chars[1:][line_chars[1:] > line_chars[:-1]] - 1] = False
    letters = _BACK[flat[where]]
    open_ = A.cut(mark & (flat != ord("-")))[at]
    keep = head > 0
    word_bounds = A.cut(keep)[bounds]
    word_chars = np.append(chunk_chars[:-1][keep], len(where))
    tail = ~in_head
    tails, tail_bounds = A.split(A.strings(flat[tail], A.cut(tail)[np.append(at[:-1][keep], at[-1])]), "/", empty=True)
    _, tags = _slotted(tails, tail_bounds)
    words = _words(A.strings(letters, word_chars), tags, (open_[1:] == open_[:-1])[keep])
    return _sentence(lines, words, word_bounds, A.strings(letters, line_chars), (confs[inner], A.cut(inner)[line_chars]))


@_reader
def read_confident(blocks: pa.Array) -> pa.Array:
    """A block of lines: a full line, the confidences between characters, and a line of tag scores a level.

    Confidences are written without sign; the words give it. Of a list of scores the first counts.
    """
    lines, at = A.split(blocks, "\n", empty=True)
    many = np.diff(at)
    words, bounds = _full(lines.take(pa.array(at[:-1])))
    second = pc.fill_null(lines.take(pa.array(np.where(many > 1, at[:-1] + 1, -1), mask=many < 2)), "")
    given, given_bounds = A.split(second, " ")
    said, said_bounds = _said(words.field("surface"), bounds)
    if len(bad := np.flatnonzero(np.diff(given_bounds) != np.diff(said_bounds))):
        raise ValueError(f"as many confidences as places between characters are needed: {blocks[int(bad[0])].as_py()}")
    coded = given.dictionary_encode()
    numbers = coded.dictionary.cast(pa.float64()).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(given) else np.zeros(0)
    confs = np.where(said < 0, -numbers, numbers)
    # the scores of the word's first tag at each level
    tags = words.field("tags")
    slots, levels = A.flattened(tags)
    each, alternatives = A.flattened(slots)
    first = A.cut(alternatives)[:-1]
    owner = np.repeat(np.arange(len(words)), levels)
    level = np.arange(len(slots)) - np.repeat(A.cut(levels)[:-1], levels)
    row = np.repeat(np.arange(len(blocks)), np.diff(bounds))[owner]
    place = owner - bounds[row]
    scores, score_bounds = A.split(lines, " ")
    line = at[:-1][row] + 2 + level
    there = (level + 2 < many[row]) & (alternatives > 0)
    there[there] = place[there] < np.diff(score_bounds)[line[there]]
    if there.any():
        best = pc.list_element(pc.split_pattern(scores.take(pa.array(score_bounds[line[there]] + place[there])), "&"), 0)
        new = each.field("score").to_numpy(zero_copy_only=False).copy()
        new[first[there]] = best.cast(pa.float64()).to_numpy(zero_copy_only=False)
        each = pa.StructArray.from_arrays([each.field("tag"), pa.array(new)], ["tag", "score"])
        tags = A.lists(A.cut(levels), A.lists(A.cut(alternatives), each))
        words = pa.StructArray.from_arrays([tags if f == "tags" else words.field(f) for f in ("surface", "norm", "tags", "is_certain", "unknown")], ["surface", "norm", "tags", "is_certain", "unknown"])
    return _sentence(blocks, words, bounds, None, (confs, said_bounds))


def word_confs(words: Column) -> Column:
    """What the words say of the places between characters."""
    inner = F.flatten(F.transform(words["surface"], lambda s: F.concat(F.array_repeat(F.lit(-SURE), F.length(s) - 1), F.array(F.lit(SURE)))))
    return F.get(F.transform(F.array(inner), lambda i: F.when(F.size(i) > 0, F.slice(i, 1, F.size(i) - 1)).otherwise(F.array().cast("array<double>"))), F.lit(0))


def _writer(kernel: Callable[..., pa.Array], fields: tuple[str, ...]) -> Callable[..., Column]:
    """A writer of columns from one of arrays of the sentence's fields."""

    def write(s: Column, *options) -> Column:
        if len(fields) == 1:

            def run(a: pa.Array) -> pa.Array:
                return kernel(A.whole(a), *options)

            run.__annotations__ = {"a": pa.Array, "return": pa.Array}
        else:

            def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
                return kernel(A.whole(a), A.whole(b), A.whole(c), *options)

            run.__annotations__ = {"a": pa.Array, "b": pa.Array, "c": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "string")(*[s[f] for f in fields])

    return write


def _escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"([ /&\\])", r"\\\1")


def _some(texts: pa.Array, bounds: np.ndarray, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    return texts.filter(pa.array(keep)), A.cut(keep)[bounds]


def _nulled(a: pa.Array, like: pa.Array) -> pa.Array:
    return pc.if_else(like.is_valid(), a, pa.scalar(None, pa.string())) if like.null_count else a


def _levels(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(tags, bounds of each level's, bounds of each word's levels)."""
    slots, levels = A.flattened(words.field("tags"))
    each, many = A.flattened(slots)
    return each, A.cut(many), A.cut(levels)


def _marks(words: pa.Array, mark: str) -> pa.Array:
    unknown = pc.fill_null(words.field("unknown"), False)
    return pc.if_else(unknown, pa.scalar(mark), pa.scalar(""))


def _full_text(lists: pa.Array, unknown_mark: str, all_tags: bool, surfaces: bool, keep_empty: bool) -> pa.Array:
    words, many = A.flattened(lists)
    each, bounds, levels = _levels(words)
    keep = each.field("tag").is_valid().to_numpy(zero_copy_only=False).copy()
    if not all_tags:
        first = np.zeros(len(each), bool)
        first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        keep &= first
    tags, bounds = _some(each.field("tag"), bounds, keep)
    slots = A.joined(_escaped(tags), bounds, "&")
    if not keep_empty:
        slots, levels = _some(slots, levels, pc.not_equal(slots, "").to_numpy(zero_copy_only=False))
    if surfaces:
        n, size = len(words), np.diff(levels) + 1
        at = A.cut(size)
        take = np.empty(at[-1], np.int64)
        inner = np.ones(at[-1], bool)
        inner[at[:-1]] = False
        take[at[:-1]], take[inner] = np.arange(n), n + np.arange(len(slots))
        slots, levels = pa.concat_arrays([_escaped(words.field("surface")), slots]).take(pa.array(take)), at
    text = pc.binary_join_element_wise(A.joined(slots, levels, "/"), _marks(words, unknown_mark), "")
    return _nulled(A.joined(text, A.cut(many), " "), lists)


def write_full(s: Column, unknown_mark: str = "", all_tags: bool = False, words: bool = True, keep_empty: bool = False) -> Column:
    """``word/tag/tag``; a level without tags is left out unless ``keep_empty``."""
    return _writer(_full_text, ("words",))(s, unknown_mark, all_tags, words, keep_empty)


def write_tags(s: Column, unknown_mark: str = "") -> Column:
    return write_full(s, unknown_mark, words=False)


def _tokenized_text(lists: pa.Array, unknown_mark: str) -> pa.Array:
    words, many = A.flattened(lists)
    return _nulled(A.joined(pc.binary_join_element_wise(words.field("surface"), _marks(words, unknown_mark), ""), A.cut(many), " "), lists)


def write_tokenized(s: Column, unknown_mark: str = "") -> Column:
    return _writer(_tokenized_text, ("words",))(s, unknown_mark)


def write_raw(s: Column) -> Column:
    return s["surface"]


def _partial_text(surface: pa.Array, confs: pa.Array, lists: pa.Array, confidence: float) -> pa.Array:
    flat, bounds = A.points(surface)
    values, many = A.flattened(confs)
    row = np.repeat(np.arange(len(surface)), many)
    place = np.arange(len(values)) - np.repeat(A.cut(many)[:-1], many)
    fits = place < np.diff(bounds)[row]
    values = values.to_numpy(zero_copy_only=False)
    marks = np.zeros(len(flat), np.uint32)
    marks[(bounds[:-1][row] + place)[fits]] = np.where(values > confidence, ord("|"), np.where(values < -confidence, ord("-"), ord(" ")))[fits]
    words, many = A.flattened(lists)
    each, at, levels = _levels(words)
    if not len(levels) or not levels[-1]:
        text = A.interleave(flat, bounds, marks)
    else:
        sure = pc.and_(pc.greater(each.field("score"), confidence), each.field("tag").is_valid())
        tags, at = _some(each.field("tag"), at, pc.fill_null(sure, False).to_numpy(zero_copy_only=False))
        slots = pc.binary_join_element_wise(pa.scalar("/"), A.joined(tags, at, "&"), "")
        own = pc.replace_substring_regex(A.joined(slots, levels, ""), "/+$", "")
        row = np.repeat(np.arange(len(surface)), many)
        ends = A.cut(A.lengths(words.field("surface")))
        last = ends[1:] - ends[A.cut(many)[:-1]][row] - 1
        fits = (last >= 0) & (last < np.diff(bounds)[row])
        codes, tag_at = A.points(own.filter(pa.array(fits)))
        where, size = (bounds[:-1][row] + last)[fits], np.ones(len(flat), np.int64)
        size += marks > 0
        np.add.at(size, where, np.diff(tag_at))
        end = A.cut(size)
        out = np.empty(end[-1], np.uint32)
        out[end[:-1]] = flat
        out[end[1:][marks > 0] - 1] = marks[marks > 0]
        out[np.repeat(end[where] + 1, np.diff(tag_at)) + np.arange(len(codes)) - np.repeat(tag_at[:-1], np.diff(tag_at))] = codes
        text = A.strings(out, end[bounds])
    return _nulled(text, surface)


def write_partial(s: Column, confidence: float = 0.0) -> Column:
    """Characters and marks; the tags above the confidence stand at the end of their word."""
    return _writer(_partial_text, ("surface", "ws_confs", "words"))(s, confidence)


def _number(x: float | None) -> str | None:
    """Six significant digits, as short as they go."""
    if x is None:
        return None
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    d = Decimal(repr(x))
    if d:
        d = d.quantize(Decimal((0, (1,), d.adjusted() - 5)), ROUND_HALF_UP, _WIDE)
    power = d.adjusted() if d else 0
    text = f"{d:.{max(5 - power, 0)}f}" if -4 <= power < 6 else f"{d:.5e}"
    if "e" in text:
        mantissa, exponent = text.split("e")
        text = f"{mantissa}e{exponent[0]}{int(exponent[1:]):02d}"
    return re.sub(r"\.$", "", re.sub(r"(\.\d*?)0+$", r"\1", text))


_WIDE = Context(prec=400)


def _numbers(values: pa.Array) -> pa.Array:
    coded = values.dictionary_encode()
    return pa.array([_number(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _confident_text(surface: pa.Array, confs: pa.Array, lists: pa.Array, levels: int | None) -> pa.Array:
    values, many = A.flattened(confs)
    out = pc.binary_join_element_wise(_full_text(lists, "", True, True, False), A.joined(_numbers(pc.abs(values)), A.cut(many), " "), "\n")
    words, many = A.flattened(lists)
    rows = A.cut(many)
    each, at, level = _levels(words)
    size = np.diff(level)
    most = np.full(len(lists), levels or 0)
    if levels is None and len(words):
        some = np.flatnonzero(many > 0)
        most[some] = np.maximum.reduceat(size, rows[some])
    if len(most) and most.max() > 0:
        scores = each.field("score")
        scores, at = _some(_numbers(scores), at, scores.is_valid().to_numpy(zero_copy_only=False))
        slots = A.joined(scores, at, "&")
        for k in range(int(most.max())):
            own = slots.take(pa.array(np.where(size > k, level[:-1] + k, 0), mask=size <= k))
            own = pc.if_else(pc.equal(pc.fill_null(own, ""), ""), "0", own)
            more = pc.binary_join_element_wise(out, A.joined(own, rows, " "), "\n")
            out = pc.if_else(pa.array(most > k), more, out)
    return _nulled(_nulled(out, lists), confs)


def write_confident(s: Column, levels: int | None = None) -> Column:
    """The block that read_confident reads, without the blank line after it."""
    return _writer(_confident_text, ("surface", "ws_confs", "words"))(s, levels)


def _dependency_text(lists: pa.Array) -> pa.Array:
    words, many = A.flattened(lists)
    rows = A.cut(many)
    number = np.arange(len(words)) - np.repeat(rows[:-1], many)
    each, at, level = _levels(words)
    first = level[:-1]
    there = (level[1:] > first) & (np.append(np.diff(at), 0)[np.minimum(first, len(at) - 1)] > 0)
    tag = each.field("tag").take(pa.array(np.where(there, at[np.minimum(first, len(at) - 1)], 0), mask=~there))
    parts = [pa.array(number + 1).cast(pa.string()), pa.array(number + 2).cast(pa.string()), words.field("surface"), pc.fill_null(tag, "UNK"), pa.scalar("0")]
    return _nulled(A.joined(pc.binary_join_element_wise(*parts, " "), rows, "\n"), lists)


def dependency_rows(s: Column) -> Column:
    """A row a word: number, next number, surface, first tag (UNK if none), 0."""
    return _writer(_dependency_text, ("words",))(s)


def write_dependency(s: Column, number: Column) -> Column:
    """A block: its number and a row a word."""
    return dependency_block(dependency_rows(s), number)


def dependency_block(rows: Column, number: Column) -> Column:
    return F.concat(F.lit("ID="), number.cast("string"), F.lit("\n"), rows)


def marked(words: Column, end: str, inner: str, known: str = "") -> Column:
    """Words as a partially annotated line: the marks at their ends and within them; ``known``: only after these characters, a blank after others."""

    def run(a: pa.Array) -> pa.Array:
        some = np.array([ord(c) for c in known], np.uint32)
        rule = lambda flat, ends, last: np.where(last, 0, np.where(np.isin(flat, some) if known else True, np.where(ends, ord(end), ord(inner)), ord(" ")))
        return _nulled(A.marked(A.whole(a), rule, _SPECIAL), A.whole(a))

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(words)


def marked_words(words: Column, inner: str) -> Column:
    """Each word with the mark between its characters."""

    def run(a: pa.Array) -> pa.Array:
        return A.marked(A.whole(a), lambda flat, ends, last: np.where(ends, 0, ord(inner)), _SPECIAL, by_word=True)

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(words)


READERS = {"full": read_full, "tags": read_full, "tok": read_tokenized, "part": read_partial, "conf": read_confident, "raw": read_raw}
WRITERS = {"full": write_full, "tags": write_tags, "tok": write_tokenized, "part": write_partial, "conf": write_confident, "raw": write_raw}


def parse(lines: DataFrame, fmt: str, column: str = "value") -> DataFrame:
    """The frame with the columns of the sentence in place of the line."""
    fmt = format_name(fmt)
    if fmt == "eda":
        raise NotImplementedError("the dependency format is for output only")
    return lines.withColumn("_s", READERS[fmt](F.col(column))).select(*[c for c in lines.columns if c != column], "_s.*")


def sentence() -> Column:
    return F.struct("surface", "norm", "ws_confs", "words")


def render(sentences: DataFrame, fmt: str, **options) -> DataFrame:
    """A frame of one text column, ``value``; the dependency format needs ``number``, the column that numbers its blocks."""
    fmt = format_name(fmt)
    if fmt == "eda":
        return sentences.select(write_dependency(sentence(), F.col(options.get("number", "sent_id"))).alias("value"))
    return sentences.select(WRITERS[fmt](sentence(), **options).alias("value"))


def read_corpus(spark: SparkSession, paths: str | list[str], fmt: str, encoding: str = "utf8") -> DataFrame:
    """Sentences of files: columns path, line_no (ascending within a file) and those of the sentence."""
    fmt = format_name(fmt)
    if encoding == "utf8":
        reader = spark.read.option("lineSep", "\n\n") if fmt == "conf" else spark.read
        lines = reader.text(paths).withColumn("value", F.regexp_replace("value", "\r?\n?$", ""))
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), "value")
        lines = lines.where("value <> ''") if fmt == "conf" else lines
    else:
        text = decode_bytes(F.col("content"), encoding)
        files = spark.read.format("binaryFile").load(paths).select("path", F.regexp_replace(text, "\n$", "").alias("text"))
        lines = files.select("path", F.posexplode(F.split("text", "\n\n" if fmt == "conf" else "\r?\n")).alias("line_no", "value"))
    return parse(lines, fmt)


def write_corpus(sentences: DataFrame, path: str, fmt: str, **options) -> None:
    out = render(sentences, fmt, **options)
    blocks = format_name(fmt) in ("conf", "eda")
    out.select(F.concat("value", F.lit("\n" if blocks else ""))).write.text(path)
