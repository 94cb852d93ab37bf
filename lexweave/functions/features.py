"""Feature names of boundaries and words, sentence by sentence."""

from __future__ import annotations

from ..operators.matching import boundary_features


def boundary_ngrams(seq: str, prefix: str, window: int, order: int) -> list[list[str]]:
    """For each boundary of the sequence its n-gram features ``{prefix}{offset}{gram}``."""
    size, out = len(seq), []
    for i in range(size - 1):
        last = min(i + window, size - 1)
        own = []
        for j in range(max(0, i - window + 1), last + 1):
            own += [f"{prefix}{j - i}{seq[j:e]}" for e in range(j + 1, min(j + order, last + 1) + 1)]
        out.append(own)
    return out


def word_ngrams(seq: str, prefix: str, start: int, end: int, window: int, order: int) -> list[str]:
    """N-grams of the characters around a word, which itself is skipped: they may span it."""
    before = seq[max(0, start - window) : start]
    around = before + seq[end : end + window]
    first = 1 - len(before)
    return [f"{prefix}{first + j}{around[j:e]}" for j in range(len(around)) for e in range(j + 1, min(j + order, len(around)) + 1)]


def self_features(word: str, types: str) -> list[str]:
    return [f"SX{word}", f"ST{types}"]


def tag_dictionary_features(entry: list[tuple[int, int]] | None) -> list[str]:
    """``D{d}T{t}`` for each (tag index, mask) of the word's level; UNK if no dictionary has any."""
    out = [f"D{d}T{t}" for t, mask in entry or () for d in range(8) if mask >> d & 1]
    return out or ["UNK"]


def sentence_boundary_features(norm: str, types: str, found: list[tuple[int, int, int]], config) -> list[list[str]]:
    """All features of each boundary: characters, types, dictionary matches (end, size, mask)."""
    rows = boundary_ngrams(norm, "X", config.char_window, config.char_order)
    for own, more in zip(rows, boundary_ngrams(types, "T", config.type_window, config.type_order)):
        own += more
    for b, name in sorted(boundary_features(found, len(norm), config.dict_cap)):
        rows[b].append(name)
    return rows


def context_features(norm: str, types: str, start: int, end: int, config) -> list[str]:
    return word_ngrams(norm, "X", start, end, config.char_window, config.char_order) + word_ngrams(types, "T", start, end, config.type_window, config.type_order)
