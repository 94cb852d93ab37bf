"""Operator 4: SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

A text is a blank and its characters; blanks are the pieces' word mark. From
single characters on, the candidate merge of the best score in a word (ties:
the leftmost) is carried out until none is left. A candidate is skipped, for
good, if the keyed hash of (seed, document, start, middle, end) falls below
``dropout``: an encoding depends on seed, document and text alone, not on the
partition it is made in. The agendas of all words of a batch advance together,
one merge a word and step, over arrays. No piece holds a word mark after
another character, so words don't meet. A character without a piece becomes
the pieces of its UTF-8 bytes, so every text decodes to itself.

With ``dropout`` 0 the ids are those of the public library for the same model.

Defined results:

* Null text: null ids. Empty text: no ids. Null ids of documents hash as a value of their own.
* Repeated rows get equal ids; with equal text but other ids they differ by dropout.
* The word mark itself (U+2581) in a text can't be told from a blank: it decodes to a blank, as in the library.
* Texts that look like control pieces are ordinary text. Empty table: empty result.
* A very long text is encoded whole, beside no other. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import pick
from .wordhash import chunks, mix, relax, string_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20240229
MARK = 0x2581
_LAST = np.int32(2**31 - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_CSUM = np.uint64((0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9 + 0xD6E8FEB86659FD93) % (1 << 64))
#: Bytes of text whose agendas advance together: arrays that fit the cache.
TOGETHER = 1 << 17


class Pieces:
    """The pieces of a merge-type model with byte fallback, as tables for array look-up."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in plain):
            raise ValueError("a piece holds a word mark after another character")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in self.byte):
            raise ValueError("the model has no byte pieces: not every text could be decoded")
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = sorted(plain.values(), key=lambda i: (-sp.get_score(i), i))
        #: The place of a piece in the agenda's order, and the piece at each place.
        self.place = np.full(n, _LAST, np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.piece = np.array(order, np.int32)
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        keys, bits = np.array(sorted(pairs), np.uint64), 20
        while len(keys) * 4 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.merged = np.full(1 << bits, 0xFFFFFFFFFFFFFFFF, np.uint64), np.full(1 << bits, -1, np.int32)
        self.probes = 1
        for k, home in zip(keys, ((keys * _C[0]) >> self.shift).astype(np.int64).tolist()):
            at, step = home, 1
            while self.key[at] != np.uint64(0xFFFFFFFFFFFFFFFF):
                at, step = (at + 1) & self.mask, step + 1
            self.key[at], self.merged[at], self.probes = k, pairs[int(k)], max(self.probes, step)
        text = [b""] * n
        for i in range(n):
            text[i] = b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(chr(MARK), " ").encode()
        for b, i in enumerate(self.byte):
            text[i] = bytes([b])
        self.text = pa.array(text, pa.binary())

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        out = np.full(len(left), -1, np.int32)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[ask].astype(np.uint64) << np.uint64(32)) | right[ask].astype(np.uint64)
        at = ((key * _C[0]) >> self.shift).astype(np.int64)
        for _ in range(self.probes):
            found = self.key[at]
            hit = found == key
            out[ask[hit]] = self.merged[at[hit]]
            on = ~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not on.any():
                break
            ask, key, at = ask[on], key[on], (at[on] + 1) & self.mask
        return out

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids; null for null."""
        if not len(ids):
            return pa.array([], pa.string())
        lists = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self.text.cast(pa.large_binary()).take(ids.values))
        raw = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
        try:
            text = raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # ids of another origin
            text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
        # the first blank is the encoder's
        text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
        return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string())


@cache
def tables(model: bytes) -> Pieces:
    return Pieces(model)


def load(path: str) -> Pieces:
    return tables(Path(path).read_bytes())


def sent(spark: SparkSession, path: str):
    """The model's file, read by the driver and sent to the tasks: machines need no copy of it."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each with a word mark before it if it isn't empty, blanks as marks; and bounds."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    first = at[offsets]
    full = np.flatnonzero(np.diff(first))
    codes = np.insert(codes, first[:-1][full], MARK)
    bounds = first + np.concatenate([[0], np.cumsum(np.diff(first) > 0)])
    codes[codes == 32] = MARK
    return codes, bounds


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    return mix(key + start.astype(np.uint64) * _C[1] + middle.astype(np.uint64) * _C[2] + end.astype(np.uint64) * _C[3]) < limit


def encode(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of each text given as bytes; ``keys`` seed the texts' dropout."""
    codes, bounds = _codes(data, offsets)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int32), bounds
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
    base = (keys - bounds[:-1].astype(np.uint64) * _CSUM)[doc]
    first = pieces.char[codes]
    # a word begins at a mark after another character, and at the start of a text
    mark = codes == MARK
    begins = np.zeros(n, bool)
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    begins[1:] |= mark[1:] & ~mark[:-1]
    out, alive = first, np.ones(n, bool)

    def rate(left, right, start, middle, end):
        """The places of candidate merges; none for pairs that make no piece and for skipped ones."""
        got = pieces.join(left, right)
        live = np.flatnonzero(got >= 0)
        found = pieces.place[got[live]]
        if dropout > 0:
            s = start[live]
            found[_skipped(base[s], s, middle[live], end[live], limit)] = _LAST
        place = np.full(len(got), _LAST, np.int32)
        place[live] = found
        return place

    pos, sym = np.arange(n, dtype=np.int32), first.copy()
    word = np.flatnonzero(begins)
    many = np.diff(np.append(word, n))
    stop = (word + many).astype(np.int32)
    # the candidate at a symbol is its merge with the next one of its word
    place = np.full(n, _LAST, np.int32)
    inner = np.flatnonzero(~begins[1:]).astype(np.int32)
    place[inner] = rate(sym[inner], sym[inner + 1], inner, inner + 1, inner + 2)
    while len(word):
        least = np.minimum.reduceat(place, word)
        going = least < _LAST
        due = np.repeat(np.where(going, least, -1), many)
        hits = np.flatnonzero(place == due)
        if not len(hits):
            break
        owner = np.searchsorted(word, hits, "right") - 1
        leftmost = np.concatenate([[True], owner[1:] != owner[:-1]])
        at, owner = hits[leftmost], owner[leftmost]
        new = pieces.piece[place[at]]
        sym[at] = new
        out[pos[at]] = new
        alive[pos[at + 1]] = False
        # finished words leave, and so does the second part of each merge
        keep = due >= 0
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        pos, sym, place = pos[keep], sym[keep], place[keep]
        inside = at - word[owner]
        many, stop = many[owner] - 1, stop[owner]
        ends = np.cumsum(many)
        word = ends - many
        at = word + inside
        # the candidates on both sides of the merged symbol are new
        place[at] = _LAST
        more = np.flatnonzero(at + 1 < ends)
        left = np.flatnonzero(inside > 0)
        c = np.concatenate([at[left] - 1, at[more]])
        own = np.concatenate([left, more])
        after = np.minimum(c + 2, len(pos) - 1)
        place[c] = rate(sym[c], sym[c + 1], pos[c], pos[c + 1], np.where(c + 2 < ends[own], pos[after], stop[own]))
    starts = np.flatnonzero(alive)
    ids, doc = out[starts], doc[starts]
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        raw = [np.frombuffer(chr(c).encode("utf-8"), np.uint8) for c in codes[starts[lone]].tolist()]
        many = np.ones(len(ids), np.int64)
        many[lone] = [len(r) for r in raw]
        ids, doc = np.repeat(ids, many), np.repeat(doc, many)
        ids[ids < 0] = pieces.byte[np.concatenate(raw)]
    return ids.astype(np.int32), np.searchsorted(doc, np.arange(len(bounds)))


def _encoder(held, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tables(held.value)
        for b in batches:
            text = b.column("text")
            data, offsets = string_bytes(text)
            keys = mix(b.column("key").to_numpy().view(np.uint64) ^ np.uint64(seed) * _C[0])
            there = text.is_valid()
            for lo, hi in chunks(offsets, TOGETHER):
                ids, bounds = encode(pieces, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], keys[lo:hi], dropout)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                back = pieces.decode(lists)
                known = there.slice(lo, hi - lo)
                same = pc.equal(back, pc.replace_substring(text.slice(lo, hi - lo).fill_null(""), chr(MARK), " "))
                no = pa.scalar(None, lists.type)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pc.if_else(known, lists, no), pc.if_else(known, pc.list_value_length(lists), pa.scalar(None, pa.int32())), pc.if_else(known, same, pa.scalar(None, pa.bool_()))], ["doc_id", "ids", "pieces", "round_trip"])
        relax()

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, pieces, round_trip) of every document: its ids, their number, and whether they decode to its text."""
    if not 0 <= dropout <= 1:
        raise ValueError("dropout is a probability")
    texts = pick(docs, id="doc_id:bigint", text="text").select("id", F.xxhash64("id", F.isnull("id")).alias("key"), "text")
    return texts.mapInArrow(_encoder(sent(docs.sparkSession, model), dropout, seed), "doc_id bigint, ids array<int>, pieces int, round_trip boolean")


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of an array of ids; null for null."""

    held = sent(SparkSession.active(), model)

    @F.arrow_udf("string")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = tables(held.value)
        for a in arrays:
            yield pieces.decode(a)

    return run(ids)
