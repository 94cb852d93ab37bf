"""Operator 6: licence notices by a positional index of rare words.

Templates are word sequences of licence notices; each names the key phrases
that must be there. How rare each of their words is follows from the document
frequencies in the whole corpus. A template posts the ``posted`` rarest words of
its key phrases, with their positions, in the index; a file's words that are posted are
looked up, all others aren't. A posting (template, position) and a word's place
give the place where the template would begin; where ``anchors`` words (or all
of a template's posted ones) agree on it, give or take ``slack`` words, the
template is aligned, and it is reported if every key phrase stands where the
alignment puts it, give or take ``slack``. So words outside the key phrases may
be changed, left out or put in, up to ``slack`` of them between one phrase and
the next.

Defined results:

* Words are runs of letters, digits and non-ASCII characters other than signs, in lower case; a character of a script without blanks is a word; all else separates.
* Null or empty text has no licence. Repeated rows are each reported. Null ids are kept.
* A very long text is read whole, in time in proportion to its length. Other columns, whatever their names, aren't read.
* Notices that overlap, or that hold each other, are each reported. Empty table: empty result.
* One row for each template and document, with the number of places and the first.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick
from .wordhash import chunks, hash_word, span_hashes, string_bytes, word_spans

ANY = "*"
SCHEMA = "doc_id bigint, license string, places int, first_word int"
ANCHORS = 2
POSTED = 4
SLACK = 4


@dataclass(frozen=True)
class Template:
    """A notice: its words, ``*`` for a word that may be any, and the phrases that must stand in it."""

    name: str
    text: str
    phrases: tuple[str, ...]


def _line(name: str, text: str) -> Template:
    return Template(name, text, (text,))


def _gnu(name: str, kind: str, version: str) -> Template:
    """The header that goes at the start of files under a licence of this family."""
    return Template(
        name,
        f"This program is free software: you can redistribute it and/or modify * * the terms of the {kind} as published by the Free Software Foundation, * version {version} of the License",
        ("you can redistribute it and or modify", f"terms of the {kind} as published by", f"version {version} of the license"),
    )


_SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "BSL-1.0", "WTFPL", "MPL-2.0", "EPL-2.0", "EUPL-1.2", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later",
)
TEMPLATES = (
    # lines that name a licence
    _line("MIT", "released under the MIT License"),
    Template("MIT-title", "MIT License Copyright", ("mit license copyright",)),
    _line("Apache-2.0", "licensed under the Apache License, Version 2.0"),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("licensed under the gnu general public license version 3",)),
    _line("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    _line("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    _line("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    _line("CC-BY-4.0", "Licensed under CC BY 4.0"),
    Template("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication", ("cc0 1 0 universal",)),
    _line("All-rights-reserved", "All rights reserved"),
    *(
        _line(f"CC-{code}-4.0-name", f"licensed under a Creative Commons {name} 4.0 International License")
        for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    ),
    *(_line(f"SPDX:{name}", f"SPDX-License-Identifier: {name}") for name in _SPDX),
    # texts and headers
    Template(
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of * software and associated documentation files (the Software), to deal in the Software without restriction, including * limitation the rights to use, copy, modify, merge, publish, * sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is * granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "with or without fee", "permission notice appear in all copies"),
    ),
    Template(
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, * permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "permitted provided that the following conditions are met"),
    ),
    Template("BSD-3-Clause-names", "Neither the name of * * * nor the names of its contributors may be used to endorse or promote products * from this software", ("neither the name of", "names of its contributors may be used to endorse or promote products")),
    Template("Zlib-text", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for * damages arising from the use of this software", ("in no event will the authors be held liable", "arising from the use of this software")),
    Template("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you * not use this file except in compliance with * License", ("licensed under the apache license version 2 0", "not use this file except in compliance with")),
    _gnu("GPL-3.0-header", "GNU General Public License", "3"),
    _gnu("GPL-2.0-header", "GNU General Public License", "2"),
    _gnu("LGPL-3.0-header", "GNU Lesser General Public License", "3"),
    _gnu("LGPL-2.1-header", "GNU Lesser General Public License", "2 1"),
    _gnu("AGPL-3.0-header", "GNU Affero General Public License", "3"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("subject to the terms of the mozilla public license v 2 0",)),
    Template("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0", ("under the terms of the eclipse public license 2 0",)),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ("under the boost software license version 1 0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, * compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    Template("WTFPL", "Do what the fuck you want to public license", ("what the fuck you want to public license",)),
)


def split(text: str) -> list[str]:
    """The words of a text, as strings."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    _, a, z = word_spans(data, np.array([0, len(data)]))
    return [data[i:j].tobytes().decode() for i, j in zip(a, z)]


@dataclass(frozen=True)
class Index:
    """Postings of the words worth a look-up: word hash to (template, position) pairs."""

    rare: np.ndarray
    postings: dict[int, tuple[tuple[int, int], ...]]
    needed: tuple[int, ...]
    phrases: tuple[tuple[tuple[int, tuple[int, ...]], ...], ...]
    names: tuple[str, ...]


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in _words(t)} - {ANY})


def _words(template: Template) -> list[str]:
    return [w for part in template.text.split() for w in ([ANY] if part == ANY else split(part))]


def build(templates: tuple[Template, ...], frequency: dict[str, int], documents: int, anchors: int, posted: int = POSTED) -> Index:
    idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary(templates)}
    postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
    needed, phrases = [], []
    for k, t in enumerate(templates):
        ws = _words(t)
        # words of the key phrases: where these stand, the template is found
        rarest = sorted({w for p in t.phrases for w in split(p)}, key=lambda w: (-idf[w], w))[:posted]
        for i, w in enumerate(ws):
            if w in rarest:
                postings[hash_word(w)].append((k, i))
        needed.append(min(anchors, len(rarest)))
        own = []
        for p in t.phrases:
            pw = split(p)
            at = next(i for i in range(len(ws)) if ws[i : i + len(pw)] == pw)
            own.append((at, tuple(hash_word(w) for w in pw)))
        phrases.append(tuple(own))
    return Index(np.array(sorted(postings), np.uint64), {h: tuple(p) for h, p in postings.items()}, tuple(needed), tuple(phrases), tuple(t.name for t in templates))


def _phrase_at(words: np.ndarray, phrase: tuple[int, ...], near: int, slack: int) -> int | None:
    n = len(phrase)
    for d in sorted(range(-slack, slack + 1), key=abs):
        i = near + d
        if 0 <= i <= len(words) - n and all(int(words[i + j]) == h for j, h in enumerate(phrase)):
            return i
    return None


def match(words: np.ndarray, places: np.ndarray, index: Index, slack: int) -> dict[int, set[int]]:
    """Template to the places of its first key phrase; ``places`` are those of the rare words."""
    starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in places:
        for k, i in index.postings[int(words[p])]:
            starts[k].append((int(p) - i, i))
    found: dict[int, set[int]] = defaultdict(set)
    for k, pairs in starts.items():
        pairs.sort()
        lo = 0
        for hi in range(len(pairs)):
            while pairs[hi][0] - pairs[lo][0] > slack:
                lo += 1
            if len({i for _, i in pairs[lo : hi + 1]}) < index.needed[k]:
                continue
            starts_ = sorted({s for s, _ in pairs[lo : hi + 1]})
            for s in starts_:
                at = [next((x for o in sorted(starts_, key=lambda o: abs(o - s)) if (x := _phrase_at(words, ph, o + off, slack)) is not None), None) for off, ph in index.phrases[k]]
                if all(x is not None for x in at):
                    found[k].add(at[0])
    return found


def document_frequencies(texts: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[str, int], int]:
    """In how many documents each licence word occurs, and the number of documents."""
    words = vocabulary(templates)
    hashes = np.array([hash_word(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    sorted_ = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(words), np.int64), 0
        for b in batches:
            data, offsets = string_bytes(b.column("text"))
            rows += b.num_rows
            for lo, hi in chunks(offsets):
                row, a, z = word_spans(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                h = span_hashes(data[offsets[lo] : offsets[hi]], a, z)
                k = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
                hit = sorted_[k] == h
                total[order] += np.bincount(np.unique(row[hit] * len(words) + k[hit]) % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([*words, None]), pa.array([*total.tolist(), rows])], ["word", "n"])

    # one row a licence word
    counts = {r["word"]: r["n"] for r in texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts, counts.pop(None, 0)


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, anchors: int = ANCHORS, slack: int = SLACK) -> DataFrame:
    """(doc_id, license, places, first_word) of every licence notice found."""
    texts = pick(docs, doc_id="doc_id:bigint", text="text").where("text is not null").select("doc_id", F.lower("text").alias("text"))
    frequency, n = document_frequencies(texts.select("text"), templates)
    index = build(templates, frequency, n, anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_bytes(b.column("text"))
            rows, names, places, first = [], [], [], []
            for lo, hi in chunks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                row, a, z = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
                h = span_hashes(part, a, z)
                k = np.minimum(np.searchsorted(index.rare, h), max(0, len(index.rare) - 1))
                rare = np.flatnonzero(index.rare[k] == h)
                for r in np.unique(row[rare]):
                    s, e = np.searchsorted(row, [r, r + 1])
                    own = rare[np.searchsorted(rare, s) : np.searchsorted(rare, e)] - s
                    for t, at in match(h[s:e], own, index, slack).items():
                        rows.append(lo + int(r))
                        names.append(index.names[t])
                        places.append(len(at))
                        first.append(min(at))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(first, pa.int32())], ["doc_id", "license", "places", "first_word"])

    return texts.mapInArrow(run, SCHEMA)
