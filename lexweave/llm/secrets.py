"""Operator 8: secrets found by dictionary-primed compression.

A candidate is a value in a sensitive context: what is assigned, with or without
a type, to a name such as token, password or api_key (all up to the closing
quote, or up to white space without quotes; after bearer or basic also), the
text of an XML element of such a name, the password of a URL, the body of a PEM
private key, a string that begins like a known kind of key, or a run of 20
letters, digits and + / _ = - or more, three digits at least, on a line with
such a name. Values under 8 characters are no candidates, and those under 12
only if they hold digits beside letters: compression can't tell shorter ones
from words. A compressor primed with a dictionary of identifiers compresses the text
around the candidate with and without it; the difference is what the candidate
adds. One that adds at least ``min_novelty`` bytes a character can't be
derived from identifiers or from the code around it and is reported; for values
of digits or hex digits alone, which hold less in a character, the bound is
lower in proportion to the bits of a character. Values that repeat words, names
or their surroundings cost less and aren't. The other candidates of the text
and copies of them don't count as surroundings, so a key among keys, or one
that stands in several sensitive places, is priced as if it stood alone.

Defined results:

* Null or empty text has no secrets. Offsets count characters from 0; ``end`` is exclusive.
* A very long text is scanned whole; the time is in proportion to its length, and its candidates are priced within ``AROUND`` characters.
* Case, blanks and word characters are those of ASCII, in the prefilter as in the scan. Other columns, whatever their names, are kept or not read.
* Repeated rows are each reported. Null ids are reported with a null id. Empty table: empty result.
* An unquoted value without digits that reads as code, a call or names joined by points or underscores, is no candidate.
* A value in one sensitive place that is repeated near it in a place that isn't sensitive is told by that copy and isn't reported.
* Overlapping candidates that are reported: one row from the first's start to the last's end. Values themselves are never returned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import hide, pick

MIN_NOVELTY = 0.5
MIN_CHARS = 8
#: Shorter values need a digit and a letter.
PLAIN_CHARS = 12
AROUND = 256
#: The compressor looks for no matches in the last 8 bytes: without it the name before the value would count as new, but only where the value is left out.
TAIL = b"\n" * 8
MASK = "[SECRET]"
SCHEMA = "doc_id bigint, start int, end int, context string, chars int, added_bytes int, novelty double"

_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|credentials?|auth)"
_RUN = rf"(?=[A-Za-z0-9_.:-]*?{_NAME})"
_SCHEME = r"(?:(?:bearer|basic|token)\s++)?"
_TYPE = r"[&*]?(?:'\w++\s++)?[A-Za-z_][\w.]*+(?:[\[<][^\n=]*?[\]>])?(?:\s*+\|\s*+\w++)*+[?]?"
_PEM = r"-----BEGIN (?:[A-Z0-9]++ ){0,4}?PRIVATE KEY(?: BLOCK)?-----"
_URL = r"://[^\s/?#\"'<>:@]*+:([^\s/\"'<>]+)@"
#: Also Java's syntax, like all that the scan's prefilter takes. Each run of name characters is read from its start alone, so time is linear in the text.
SENSITIVE = rf"(?i)(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?{_NAME})[A-Za-z0-9_-]++[\\\"'`\])]{{0,4}}(?:\s*+[:=]|[ \t]++{_TYPE}[ \t]*+=)"
ELEMENT = rf"(?i)<{_RUN}[A-Za-z0-9_.:-]++(?:\s[^<>]*+)?>"
KNOWN = (
    r"(?i)(?<![A-Za-z0-9_])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|[srp]k[_-](?:live_|test_|proj-)?[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|ya29\.[A-Za-z0-9_-]{20,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{32,}|hf_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
)
#: A run that counts on a line with a sensitive name; looked for where a text has such a name.
NEARBY = r"[A-Za-z0-9+/_=-]{20}"
NEARBY_DIGITS = 3
NEARBY_NOVELTY = 1.2


def _quoted() -> str:
    """All up to the closing quote: of three, escaped ones or one, in which an escaped quote doesn't close."""
    kinds = []
    for q in ("\"", "'", "`"):
        kinds += [rf"{q}{{3}}{_SCHEME}((?:(?!{q}{{3}})[\s\S])*+){q}{{3}}", rf"\\{q}{_SCHEME}((?:(?!\\{q})[^\n])*+)\\{q}", rf"{q}{_SCHEME}((?:[^{q}\\\n]|\\.)*+){q}(?!{q})"]
    return "|".join(kinds)


_ASSIGNED = re.compile(
    rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?{_NAME})(?P<name>[A-Za-z0-9_-]++)[\\\"'`\])]{{0,4}}(?:\s*+:\s*+{_TYPE}\s*+=(?![=>])|[ \t]++{_TYPE}[ \t]*+=(?![=>])|\s*+(?:=>|:=|={{1,3}}|:))"
    rf"\s*+{_SCHEME}(?:(?:[rbuf]{{1,2}}(?=[\"'`]))?(?:{_quoted()})|[\"'`\\]*+(?P<bare>\S++))",
    re.IGNORECASE | re.ASCII,
)
_ELEMENT = re.compile(rf"<{_RUN}(?P<name>[A-Za-z0-9_.:-]++)(?:\s[^<>]*+)?>(?:\s*+<!\[CDATA\[((?:(?!<!\[CDATA\[|\]\]>)[\s\S])*+)\]\]>|([^<]++)</)", re.IGNORECASE | re.ASCII)
_OTHER = {
    "": re.compile(KNOWN, re.ASCII),
    "url": re.compile(_URL, re.ASCII),
    "private key": re.compile(rf"{_PEM}(?:((?:(?!-----)[\s\S])++)(?=-----END)|((?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{16,}}+)++))", re.ASCII),
}
_WORD = re.compile(rf"{_NAME}[A-Za-z_-]*", re.IGNORECASE | re.ASCII)
_NEAR = re.compile(rf"{_NAME}s?(?![A-Za-z])", re.IGNORECASE | re.ASCII)
#: What an unquoted value without digits reads as where it is code: a call, or names joined by points or underscores.
_CODE = re.compile(r"[A-Za-z_]+(?:\([^0-9]*|(?:[._]+[A-Za-z]+)+(?:\([^0-9]*)?)", re.ASCII)
_LONG = re.compile(rf"{NEARBY}[A-Za-z0-9+/_=-]*+")
IDENTIFIERS = (
    "public static void return import export const function class private protected string int float double boolean true false null none self this "
    "password passwd secret token api_key apikey access_key private_key client_secret credentials authorization bearer basic username user "
    "getenv environ process.env config settings example changeme placeholder your_token_here your-api-key-here insert xxxxxxxx abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000 localhost http https www com org net example.com request response header session cookie "
    "context client server service account database table index value values default current previous next first last begin end start stop create update "
    "delete insert select from where order group limit offset count length size width height name names type types data file files path paths directory "
    "message error exception warning debug info logger handler manager factory builder provider controller repository module component template"
).encode()


def compressor() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def added_bytes(press: zstandard.ZstdCompressor, before: str, value: str, after: str) -> int:
    """What the value adds to the compressed size of the text around it."""
    around = f"{after}\n{before}".encode("utf-8", "surrogatepass")
    return len(press.compress(around + value.encode("utf-8", "surrogatepass") + TAIL)) - len(press.compress(around + TAIL))


def least_bytes(value: str, min_novelty: float) -> float:
    """What a value must add: ``min_novelty`` bytes a character of letters and digits, less for digits and hex digits."""
    bare = re.sub(r"[-:_.]", "", value)
    size = 10 if re.fullmatch(r"[0-9]+", bare) else 16 if re.fullmatch(r"[0-9A-Fa-f]+", bare) else 36
    return min_novelty * len(bare if size < 36 else value) * math.log2(size) / math.log2(36)


def places(text: str, values: set[str]) -> list[tuple[int, int, str]]:
    """Where the values stand in the text, in order; one pass over the text, whatever their number."""
    heads = defaultdict(list)
    for v in values:
        heads[v[:8]].append(v)
    return [(i, i + len(v), v) for i in range(len(text) - 7) if text[i : i + 8] in heads for v in heads[text[i : i + 8]] if text.startswith(v, i)]


def without(text: str, a: int, z: int, taken: list[tuple[int, int, str]], longest: int, but: str | None) -> str:
    """The text from a to z without the places in ``taken``, those of the value ``but`` excepted."""
    out = []
    for i, j, v in taken[bisect_left(taken, (a - longest,)) : bisect_left(taken, (z,))]:
        if v != but and j > a:
            out.append(text[a : max(a, i)])
            a = j
    return "".join(out) + text[a:z]


def likely(value: str) -> bool:
    """Whether a value is long enough to be told from words."""
    return len(value) >= PLAIN_CHARS or (len(value) >= MIN_CHARS and re.search("[0-9]", value) is not None and re.search("[A-Za-z]", value) is not None)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, context) of each value in a sensitive context; they may overlap."""
    found = {}
    for kind, pattern in (("name", _ASSIGNED), ("name", _ELEMENT), *_OTHER.items()):
        for m in pattern.finditer(text):
            k = m.lastindex
            a, z = m.span(k)
            if k == pattern.groupindex.get("bare"):
                # what closes or ends the text around a bare value isn't part of it
                while z > a and (text[z - 1] in "\"'`,;" or (text[z - 1] in ")]}>" and "([{<"[")]}>".index(text[z - 1])] not in text[a:z])):
                    z -= 1
                if _CODE.fullmatch(text, a, z):
                    continue
            else:
                a, z = z - len(text[a:z].lstrip()), a + len(text[a:z].rstrip())
            if likely(text[a:z]):
                found.setdefault((a, z), _WORD.search(m["name"]).group(0).lower() if kind == "name" else kind or text[a : a + 4].lower())
    lo = 0
    for line in text.split("\n") if _NEAR.search(text) else ():
        if len(line) >= 20:
            names = None
            for m in _LONG.finditer(line):
                if sum(c.isdigit() for c in m[0]) < NEARBY_DIGITS or not any(c.isalpha() for c in m[0]):
                    continue
                names = [(w.start(), w.group(0).lower()) for w in _NEAR.finditer(line)] if names is None else names
                outside = next((w for at, w in names if not m.start() <= at < m.end()), None)
                if outside:
                    found.setdefault((lo + m.start(), lo + m.end()), f"near {outside}")
        lo += len(line) + 1
    return [(a, z, c) for (a, z), c in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1]))]


def scan(text: str, press: zstandard.ZstdCompressor, min_novelty: float = MIN_NOVELTY, around: int = AROUND) -> list[tuple[int, int, str, int, float]]:
    """(start, end, context, added bytes, novelty) of the secrets of a text."""
    found = candidates(text)
    times = Counter(text[a:z] for a, z, _ in found)
    taken = places(text, set(times)) if len(found) > 1 else []
    longest = max(map(len, times), default=0)

    def price(a: int, z: int) -> int:
        but = text[a:z] if times[text[a:z]] == 1 else None
        return added_bytes(press, without(text, max(0, a - around), a, taken, longest, but), text[a:z], without(text, z, min(len(text), z + around), taken, longest, but))

    out: list[tuple[int, int, str, int, float]] = []
    for a, z, context in found:
        n = price(a, z)
        if n < least_bytes(text[a:z], min_novelty * (NEARBY_NOVELTY if context.startswith("near ") else 1)):
            continue
        if out and a < out[-1][1]:
            if z <= out[-1][1]:
                continue
            a, _, context, *_ = out.pop()
            n = price(a, z)
        out.append((a, z, context, n, round(n / (z - a), 4)))
    return out


def suspect(text: Column) -> Column:
    """Whether the text may hold a candidate; true for all that do."""
    return (text.rlike(f"(?i){_NAME}") & (text.rlike(SENSITIVE) | text.rlike(ELEMENT) | text.rlike(NEARBY))) | text.rlike(KNOWN) | text.rlike(_URL) | text.rlike(_PEM)


def candidates_only(text):
    """The text where it may hold a candidate, else null: only that passes to Python."""
    return F.when(suspect(text), text)


def find_secrets(docs: DataFrame, min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """A row for every secret."""
    some = pick(docs, doc_id="doc_id:bigint", text="text").where(suspect(F.col("text")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = compressor()
        for f in frames:
            rows = [(i, a, z, c, z - a, n, x) for i, t in zip(f["doc_id"], f["text"]) for a, z, c, n, x in scan(t, press, min_novelty)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "context", "chars", "added_bytes", "novelty"])
            yield out.astype({"doc_id": "Int64", "start": "int32", "end": "int32", "chars": "int32", "added_bytes": "int32", "novelty": "float64"})

    return some.mapInPandas(run, SCHEMA)


def mask(text: str, press: zstandard.ZstdCompressor, min_novelty: float = MIN_NOVELTY) -> str:
    for a, z, *_ in reversed(scan(text, press, min_novelty)):
        text = text[:a] + MASK + text[z:]
    return text


def redact_secrets(docs: DataFrame, min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """All documents with all their columns, each secret replaced by a mask; no row is shuffled."""
    work, where = hide(docs)
    text = F.col(where["text"]).cast("string")

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = compressor()
        for s in texts:
            yield s.map(lambda t: t if t is None else mask(t, press, min_novelty))

    both = work.withColumn("_new", masked(candidates_only(text)))
    new = F.coalesce("_new", text)
    out = []
    for i, name in enumerate(docs.columns):
        c = F.col(f"_c{i}")
        if f"_c{i}" == where["text"]:
            c = new
        elif name == "n_chars":
            c = F.when(F.isnull("_new"), c).otherwise(F.length(new)).cast(docs.schema[i].dataType)
        out.append(c.alias(f"_c{i}"))
    return both.select(*out)
