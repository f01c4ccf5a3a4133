"""Statistics of whole texts that quality rules and classifiers share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Words, hashes, windows, words_of

_SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """Of each text, the words inside runs of ``size`` words found twice or more in it."""
    found, at = windows(hashes(words.vocabulary)[words.codes], words.offsets, size)
    out = np.zeros(len(words.offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
        runs = found[a:b]
        order = np.argsort(runs, kind="stable")
        same = runs[order[1:]] == runs[order[:-1]]
        if same.any():
            twice = np.zeros(b - a + size - 1, bool)
            hit = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(size):
                twice[hit + k] = True
            out[i] = twice.sum()
    return out


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return again


def base_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of ``BASE`` for each text (null: as an empty text)."""
    texts = pc.fill_null(texts, "")
    words = words_of(texts)
    lengths = pc.utf8_length(words.vocabulary).to_numpy().astype(np.int64)
    before = np.concatenate([[0], np.cumsum(lengths[words.codes])])
    symbols = pc.count_substring_regex(texts, f"[{_SYMBOLS}]").to_numpy()
    lines = np.fromiter((duplicate_lines(t) if "\n" in t else 0 for t in texts.to_pylist()), np.int64, len(texts))
    return {
        "n_words": words.counts,
        "word_chars": before[words.offsets[1:]] - before[words.offsets[:-1]],
        "n_symbols": symbols.astype(np.int64),
        "n_dup_lines": lines,
        "n_repeat_words": repeated_words(words),
    }


def ratios(texts: pa.Array, base: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Further statistics, as shares or means, so that length alone decides none."""
    texts = pc.fill_null(texts, "")
    n = np.maximum(base["n_words"], 1)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(), 1)

    def share(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy() / chars

    words = words_of(texts, lower=True)
    distinct = np.array([len(np.unique(words.codes[a:b])) for a, b in zip(words.offsets, words.offsets[1:])])
    lines = pc.count_substring(texts, "\n").to_numpy() + 1
    return {
        "word_length": base["word_chars"] / n,
        "symbols": base["n_symbols"] / n,
        "dup_lines": base["n_dup_lines"] / lines,
        "repeats": base["n_repeat_words"] / n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "stops": share(r"[.!?]"),
        "commas": share("[,;:]"),
        "others": share(r"[^\sA-Za-z0-9.,;:!?\x{80}-\x{10FFFF}]"),
        "distinct": distinct / np.sqrt(n),
        "line_words": base["n_words"] / lines,
    }
