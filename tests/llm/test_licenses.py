import random

from lexweave.llm import licenses, queries


def test_each_template_is_found_in_other_print(spark, make):
    docs = make(*[(i, "Some code.\n/* " + t.text.replace("*", "word").upper().replace(" ", "\n * ") + " */ more") for i, t in enumerate(licenses.TEMPLATES)])
    got = {(r.doc_id, r.license) for r in licenses.find_licenses(docs).collect()}
    assert {(i, t.name) for i, t in enumerate(licenses.TEMPLATES)} <= got


def test_key_phrases_are_needed(spark, make):
    docs = make((1, "released under the MIT spirit, a License of sorts"), (2, "licensed under CC BY 4.0"), (3, "licensed under CC BY-SA 4.0 and again licensed under cc-by-sa 4.0"))
    assert sorted((r.doc_id, r.license, r.places, r.first_word) for r in licenses.find_licenses(docs).collect()) == [(2, "CC-BY-4.0", 1, 0), (3, "CC-BY-SA-4.0", 2, 0)]


REAL = {
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "SPDX:Apache-2.0": "// SPDX-License-Identifier: Apache-2.0",
    "MIT-title": "MIT License\n\nCopyright (c) 2020 A. Writer",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "CC-BY-4.0-name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_published_notices(spark, make):
    got = {(r.doc_id, r.license) for r in licenses.find_licenses(make(*[(i, f"int main() {{ return {i}; }}\n/* {x} */") for i, x in enumerate(REAL.values())])).collect()}
    assert {(i, n) for i, n in enumerate(REAL)} <= got


def test_small_edits_outside_the_key_phrases(spark, make):
    """What a search for the whole text, or for neighbours of the phrases, misses; and phrases without their notice aren't reported."""
    rng, docs, want = random.Random(3), [], []
    long = [t for t in licenses.TEMPLATES if len(licenses._words(t)) - sum(len(licenses.split(p)) for p in t.phrases) >= 6]
    assert len(long) >= 8
    for k, t in enumerate(long):
        words = licenses._words(t)
        kept = set()
        for p in t.phrases:
            pw = licenses.split(p)
            at = next(i for i in range(len(words)) if words[i : i + len(pw)] == pw)
            kept |= set(range(at, at + len(pw)))
        free = [i for i in range(len(words)) if i not in kept]
        for m in range(6):
            out = list(words)
            for i in sorted(rng.sample(free, 2), reverse=True):
                out[i : i + 1] = rng.choice(([], ["x1"], [words[i], "x2"]))
            docs.append((len(docs), "a b c d " + " ".join(out) + " e f g"))
            want.append((docs[-1][0], t.name))
    assert all(" ".join(licenses._words(t)) not in x for t in long for _, x in docs)
    t = next(t for t in long if t.name == "GPL-3.0-header")
    apart = (" filler" * 40).join(t.phrases)
    docs.append((9999, apart))
    got = {(r.doc_id, r.license) for r in licenses.find_licenses(make(*docs)).collect()}
    assert len(set(want) & got) >= 0.95 * len(want)
    assert (9999, "GPL-3.0-header") not in got


def test_index_posts_rare_words_only():
    words = licenses.vocabulary(licenses.TEMPLATES)
    index = licenses.build(licenses.TEMPLATES, {w: 1000 if w in ("the", "of", "and", "to", "in", "license") else 1 for w in words}, 2000, 2)
    assert len(index.rare) < 0.75 * len(words)
    assert all(sum(k == t for p in index.postings.values() for t, _ in p) <= 3 * licenses.POSTED for k in range(len(licenses.TEMPLATES)))
    assert licenses.hash_word("the") not in index.postings


def test_overlapping_notices(spark, make):
    got = {(r.license, r.places) for r in licenses.find_licenses(make((1, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. All rights reserved. All rights reserved"))).collect()}
    assert got == {("Apache-2.0", 1), ("Apache-2.0-header", 1), ("All-rights-reserved", 2)}


def test_query_against_sql(spark, sf, duck):
    want = duck.execute(f"SELECT doc_id, license, places, first_word FROM ({queries.SQL['op6_license_scan']})").fetchall()
    assert want and sorted(map(tuple, queries.op6_license_scan(spark, sf).collect())) == sorted(want)


def test_odd_rows(spark, odd, make):
    assert licenses.find_licenses(odd).collect() == [] and licenses.find_licenses(odd.limit(0)).collect() == []
    long = "word " * 400_000 + "All rights reserved."
    got = licenses.find_licenses(make((None, long), (None, long), (1, None)))
    assert [tuple(r) for r in got.collect()] == [(None, "All-rights-reserved", 1, 400_000)] * 2
