"""Character types, normalisation and small string functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type letter and the characters of it, the first match wins; what is left is O.
CLASSES = (
    ("R", r"[A-Za-zＡ-Ｚａ-ｚ]"),
    ("H", r"[぀-ゖ]"),
    ("T", r"[゠-ヺー-ヿｦ-ﾟ]"),
    ("D", r"[0-9０-９]"),
    ("K", r"[㐀-䶿一-鿿豈-﫿\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2F800}-\x{2FA1F}]"),
)
_HELD = "".join(chr(0xFDD0 + i) for i in range(len(CLASSES)))

_WIDE = {chr(c): chr(c + 0xFEE0) for c in [*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "(){}<>[]%?\",'+:!&*@=/_,")]}
_WIDE |= {"｢": "「", "｣": "」", "､": "、", "｡": "。", "･": "・", ".": "。", "-": "−", "～": "〜"}
_WIDE |= {'"': "”", "'": "’", **dict.fromkeys("－―─–", "ー")}
#: One-to-one substitutions: half-width letters, digits and signs to full width.
NARROW, FULL = "".join(_WIDE), "".join(_WIDE.values())
_TABLE = str.maketrans(NARROW, FULL)


def normalize(text: Column) -> Column:
    """Length-preserving normal form; null for null."""
    return F.translate(text, NARROW, FULL)


def normalize_text(text: str) -> str:
    return text.translate(_TABLE)


def type_string(text: Column) -> Column:
    """One type letter (K T H R D O) a character; null for null.

    A chain of native replacements into characters that no text may hold
    (noncharacters; those in a text count as O), so that no step sees the
    letters of another.
    """
    out = F.translate(text, _HELD, " " * len(_HELD))
    for held, (_, chars) in zip(_HELD, CLASSES):
        out = F.regexp_replace(out, chars, held)
    out = F.regexp_replace(out, rf"(?s)[^{_HELD[0]}-{_HELD[-1]}]", "O")
    return F.translate(out, _HELD, "".join(c for c, _ in CLASSES))


def char_type(code: int) -> str:
    c = code
    if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or 0xFF21 <= c <= 0xFF3A or 0xFF41 <= c <= 0xFF5A:
        return "R"
    if 0x3040 <= c <= 0x3096:
        return "H"
    if 0x30A0 <= c <= 0x30FF and c != 0x30FB or 0xFF66 <= c <= 0xFF9F:
        return "T"
    if 0x30 <= c <= 0x39 or 0xFF10 <= c <= 0xFF19:
        return "D"
    han = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2F800, 0x2FA1F))
    return "K" if any(a <= c <= b for a, b in han) else "O"


_types: dict[str, str] = {}


def type_text(text: str) -> str:
    try:
        return "".join([_types[c] for c in text])
    except KeyError:
        _types.update({c: char_type(ord(c)) for c in set(text)})
        return "".join([_types[c] for c in text])


def chars(text: Column) -> Column:
    """The characters (code points) of a text; none of an empty one."""
    return F.slice(F.split(text, ""), 1, F.length(text))


def escape(text: Column, special: str = " /&\\") -> Column:
    """A backslash before each special character."""
    return F.regexp_replace(text, "([" + "".join("\\" + c for c in special) + "])", r"\\$1")


def tokenize(text: Column, delimiters: str, keep: bool = False) -> Column:
    """The parts between delimiter characters that aren't empty; with ``keep`` the delimiters are parts too."""
    inside = "".join("\\" + c if c in "\\]^-[&" else c for c in delimiters)
    return F.regexp_extract_all(text, F.lit(f"[{inside}]|[^{inside}]+" if keep else f"[^{inside}]+"), F.lit(0))


def parse_number(text: Column, kind: str = "double") -> Column:
    """The number a text begins with; an error if there is none."""
    head = F.regexp_extract(text, r"^\s*([+-]?\d+)" if kind in ("int", "bigint") else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(F.isnull(text), None).when(head == "", F.raise_error(F.concat(F.lit("not a number: "), text))).otherwise(head.cast(kind))


def decode_bytes(content: Column, encoding: str) -> Column:
    """Text of bytes in utf8, euc or sjis; the last two need spark.sql.legacy.javaCharsets=true."""
    names = {"utf8": "UTF-8", "euc": "EUC-JP", "sjis": "Shift_JIS"}
    if encoding not in names:
        raise ValueError(f"unknown encoding {encoding!r}")
    return F.decode(content, names[encoding])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
