"""Character n-grams of whole texts as hashed numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pagelake.llm.common import process_cache

# Code of everything between words, and between texts.
GAP = 0
END = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """True where a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, non-letters as gaps, and the end of each text."""
    joined = "".join(f"\x00{t.lower()}\x00" if "\x00" not in t else f"\x00{t.lower().replace(chr(0), ' ')}\x00" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == 0)[1::2] + 1
    letters = process_cache("letters", letter_table)
    return np.where(letters[codes], codes, GAP).astype("uint64"), ends


def hashed(codes: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size: place and 64-bit hash of every n-gram within a word, its edges as marks.

    A window may begin or end with one gap, as the mark of the word's edge, but
    holds no gap inside.
    """
    gap = codes == GAP
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        inside = gap[1:m + 1].copy() if n > 2 else np.zeros(m, bool)
        for j in range(2, n - 1):
            inside |= gap[j:m + j]
        if n == 2:
            inside = gap[:m] & gap[1:m + 1]
        at = np.flatnonzero(~inside)
        h = np.full(len(at), n, "uint64")
        for j in range(n):
            h = (h + codes[at + j] + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield at, h ^ (h >> np.uint64(32))


def per_text(values: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the places of each text."""
    edges = np.searchsorted(at, np.concatenate(([0], ends)))
    total = np.concatenate(([0.0], np.cumsum(values, dtype="float64")))
    return total[edges[1:]] - total[edges[:-1]]
