"""Counting quotient filters of packed n-grams, as arrays: lossless counters that merge as sorted lists do (operator 11).

n word ids of `bits` bits are one number of n * bits bits. A Feistel network permutes these numbers (it can be inverted, so
nothing is lost), which spreads them evenly. Of a permuted number its leading bits say which part of all filters it belongs to, the
next ones are the quotient, and the others the remainder, which is stored in full.
A filter has a unary string of the runs of equal quotients, the remainders in order, and a byte for each counter (those
from 255 up stand in a list of their own).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Odd multipliers of the Feistel rounds.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
Keys = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Packing:
    """How n-grams of n ids below 2 ** bits are packed: permuted numbers have 2 * half bits, in two words of 64 (high, low)."""

    n: int
    bits: int

    def __post_init__(self) -> None:
        if not 0 < self.bits <= 31 or not 0 < self.n <= 4:
            raise ValueError("up to four ids of up to 31 bits")

    @property
    def half(self) -> int:
        return max(1, -(-self.n * self.bits // 2))

    def _round(self, x: np.ndarray, by: int) -> np.ndarray:
        x = (x + U(1)) * U(by)
        x ^= x >> U(29)
        x *= U(ROUNDS[0])
        return (x >> U(64 - self.half)) & U((1 << self.half) - 1)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> Keys:
        """left * 2 ** half + right."""
        h = self.half
        if 2 * h <= 64:
            return np.zeros(len(left), U), left << U(h) | right if h < 64 else right
        return left >> U(64 - h), left << U(h) | right

    def _halves(self, keys: Keys) -> Keys:
        high, low = keys
        h = self.half
        mask = U((1 << h) - 1)
        return ((low >> U(h)) | (high << U(64 - h))) & mask, low & mask

    def pack(self, ids: list[np.ndarray]) -> Keys:
        """Permuted numbers of n-grams: ids[k] has the k-th id of each."""
        high, low = np.zeros(len(ids[0]), U), np.zeros(len(ids[0]), U)
        for x in ids:
            high, low = high << U(self.bits) | low >> U(64 - self.bits), low << U(self.bits) | x.astype(U)
        left, right = self._halves((high, low))
        for by in ROUNDS:
            left, right = right, left ^ self._round(right, by)
        return self._joined(left, right)

    def unpack(self, keys: Keys) -> list[np.ndarray]:
        left, right = self._halves(keys)
        for by in reversed(ROUNDS):
            left, right = right ^ self._round(left, by), left
        high, low = self._joined(left, right)
        out = []
        for _ in range(self.n):
            out.append((low & U((1 << self.bits) - 1)).astype(np.int64))
            high, low = high >> U(self.bits), low >> U(self.bits) | high << U(64 - self.bits)
        return out[::-1]

    def part(self, keys: Keys, part_bits: int) -> np.ndarray:
        """The leading bits, as many as there are up to part_bits."""
        return (self._halves(keys)[0] >> U(self.half - self.part_bits(part_bits))).astype(np.int64)

    def part_bits(self, wanted: int) -> int:
        return min(wanted, self.half)


def counted(keys: Keys, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """The distinct keys in order, and their counts in all (1 for each where none are given)."""
    high, low = keys
    if not len(low):
        return keys, np.zeros(0, np.int64)
    if not high.any() and counts is None:
        low, n = np.unique(low, return_counts=True)
        return (np.zeros(len(low), U), low), n
    order = np.lexsort((low, high)) if high.any() else np.argsort(low, kind="stable")
    high, low = high[order], low[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(low))) if counts is None else np.add.reduceat(counts[order], at)
    return (high[at], low[at]), n


def write_filter(keys: Keys, counts: np.ndarray, packing: Packing, part_bits: int) -> bytes:
    """The filter of keys of one part, in order and distinct."""
    high, low = keys
    n = len(low)
    free = 2 * packing.half - packing.part_bits(part_bits)
    width = -(-max(0, free - (max(n, 1).bit_length() - 1)) // 8)
    quotient_bits = free - 8 * width if free > 8 * width else 0
    flat = np.zeros((n, 24), np.uint8)
    flat[:, 8:] = np.stack([high, low], 1).astype(">u8").view(np.uint8).reshape(n, 16)
    quotients = np.ascontiguousarray(flat[:, 16 - width : 24 - width]).view(">u8").reshape(n).astype(U) & U((1 << quotient_bits) - 1)
    runs = np.ones(n + (1 << quotient_bits), np.uint8)  # a 1 per key, a 0 behind each quotient's
    runs[np.arange(1 << quotient_bits) + np.cumsum(np.bincount(quotients.astype(np.int64), minlength=1 << quotient_bits))] = 0
    large = counts[counts >= 255].astype("<u8")
    head = np.array([n, len(large), width, quotient_bits], "<u4")
    return b"".join([head.tobytes(), np.packbits(runs).tobytes(), flat[:, 24 - width :].tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes()])


def read_filter(data: bytes, packing: Packing, part: int, part_bits: int) -> tuple[Keys, np.ndarray]:
    """Keys in order and their counts."""
    n, many, width, quotient_bits = (int(x) for x in np.frombuffer(data, "<u4", 4))
    at = 16
    size = (n + (1 << quotient_bits) + 7) // 8
    runs = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[: n + (1 << quotient_bits)]
    at += size
    ones = np.flatnonzero(runs)
    quotients = (ones - np.arange(n)).astype(U)
    flat = np.zeros((n, 24), np.uint8)
    flat[:, 24 - width :] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    over = max(0, 8 * width - (2 * packing.half - packing.part_bits(part_bits)))  # bits of the part that a remainder of whole bytes holds too
    flat[:, 16 - width : 24 - width] = (U(part >> over) << U(quotient_bits) | quotients).astype(">u8").view(np.uint8).reshape(n, 8)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", many, at + n).astype(np.int64)
    pair = np.ascontiguousarray(flat[:, 8:]).view(">u8").reshape(n, 2).astype(U)
    return (pair[:, 0], pair[:, 1]), counts
