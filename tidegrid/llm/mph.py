"""Minimal perfect hashing of 64-bit keys, in numpy arrays."""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
LEVELS = 64
HEAD = "<4sII"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of keys (the splitmix64 finaliser), another one for every seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct keys to its own slot of 0..n-1; other keys to any slot or to -1.

    Every level has a bit field of about GAMMA bits for each key that is left; a key alone on its bit stays there, the others
    go on. A key's slot is the rank of its bit over all levels, so a lookup reads a fixed number of words on average.
    """

    def __init__(self, fields: list[np.ndarray], sizes: list[int]):
        self.fields, self.sizes = fields, sizes
        words = np.concatenate(fields) if fields else np.zeros(0, np.uint64)
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        self.starts = np.cumsum([0, *map(len, fields)])
        self.words = words

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys = np.unique(np.asarray(keys).view(np.uint64))
        fields, sizes = [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("no perfect hash was found")
            size = max(64, int(GAMMA * len(keys)) + 63 >> 6 << 6)
            at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(fields, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).view(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            there = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[there]] = (self.ranks[word] + below)[there]
            left = left[~there]
            if not len(left):
                break
        return out

    def dumped(self) -> bytes:
        return struct.pack(HEAD, b"TGPH", len(self.sizes), len(self.words)) + np.array(self.sizes, "<u4").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def loaded(cls, data: bytes, at: int = 0) -> tuple[PerfectHash, int]:
        """The hash that begins at a position of data, and the position after it."""
        mark, levels, words = struct.unpack_from(HEAD, data, at)
        if mark != b"TGPH":
            raise ValueError("not a perfect hash")
        at += struct.calcsize(HEAD)
        sizes = np.frombuffer(data, "<u4", levels, at).tolist()
        at += 4 * levels
        bits = np.frombuffer(data, "<u8", words, at)
        ends = np.cumsum([0] + [s >> 6 for s in sizes])
        return cls([bits[a:b] for a, b in zip(ends, ends[1:], strict=False)], sizes), at + 8 * words
