"""Canonical length-limited Huffman codes for token ids, encoded and decoded with numpy.

Codes are at most ``MAX_BITS`` long, so a table with one entry per ``MAX_BITS``-bit
prefix decodes a symbol in one look-up.  A block keeps the bit offset of every
``STRIDE``-th id; all stretches between these checkpoints decode side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_BITS = 16
STRIDE = 64


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 where the count is 0."""
    counts = np.asarray(counts, "int64")
    lengths = np.zeros(len(counts), "uint8")
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype("float64")
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate((weights, packages))
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[0:len(merged) // 2 * 2:2] + merged[1:len(merged) // 2 * 2:2]
    # walk back: of the first `take` entries of a level, single symbols get a bit, packages open two entries
    take, bits = 2 * (len(used) - 1), np.zeros(len(used), "int64")
    for single in reversed(levels):
        n = int(single[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    lengths[used] = bits
    return lengths


@dataclass
class Code:
    """Codes follow from the lengths alone: by length, then by symbol."""

    lengths: np.ndarray

    def __post_init__(self):
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        self.order = order[self.lengths[order] > 0]
        sorted_lengths = self.lengths[self.order].astype("int64")
        # the first code of each symbol in units of the longest code
        steps = np.left_shift(1, MAX_BITS - sorted_lengths)
        begins = np.cumsum(steps) - steps
        self.codes = np.zeros(len(self.lengths), "uint64")
        self.codes[self.order] = (begins >> (MAX_BITS - sorted_lengths)).astype("uint64")
        # symbol and code length by prefix; prefixes of no code move on by a bit
        self.packed = np.ones(1 << MAX_BITS, "uint32")
        total = int(steps.sum())
        self.packed[:total] = np.repeat((self.order << 8 | sorted_lengths).astype("uint32"), steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits and the bit offset of every ``STRIDE``-th id."""
        if not len(ids):
            return b"", np.empty(0, "uint32")
        bits = self.lengths[ids].astype("int64")
        if not bits.all():
            raise ValueError("an id has no code")
        at = np.cumsum(bits) - bits
        total = int(at[-1] + bits[-1])
        code, word, shift = self.codes[ids], at >> 6, 64 - (at & 63) - bits
        split = shift < 0
        head = np.where(split, code >> np.abs(shift).astype("uint64"), code << np.maximum(shift, 0).astype("uint64"))
        words = np.zeros((total + 63) // 64 + 1, "uint64")
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(split)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype("uint64")
        return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::STRIDE].astype("uint32")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        lanes = len(checkpoints)
        raw = np.frombuffer(payload + bytes(STRIDE * MAX_BITS // 8 + 4), "uint8").astype("uint32")
        # the three bytes from each byte on hold the longest code at any bit of the first
        three = raw[:-2] << 16
        three |= raw[1:-1] << 8
        three |= raw[2:]
        out, at = np.empty((STRIDE, lanes), "uint32"), checkpoints.astype("uint32")
        for step in range(min(STRIDE, n)):
            prefix = (three[at >> 3] >> (24 - MAX_BITS - (at & 7))) & ((1 << MAX_BITS) - 1)
            found = self.packed[prefix]
            out[step] = found >> 8
            at += found & 255
        return out.T.reshape(-1)[:n]
