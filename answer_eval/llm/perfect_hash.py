"""Minimal perfect hashes over byte strings, with their keys stored in slot order.

A level is a bit array of about ``GAMMA`` bits a key: a key that is alone at its bit is placed
there, the others go on to the next level, so a handful of levels place them all.  A key's
slot is the rank of its bit among all set bits: n keys have the slots 0 to n - 1.  Strings
that are not keys also reach slots, so every answer is checked against the stored key.
Keys that no level separates (equal 64-bit hashes) are kept aside by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from answer_eval.llm.common import WordHash, mix

GAMMA = 2.0
LEVELS = 24
_HASH = WordHash(11)


def _seed(level: int) -> np.uint64:
    return np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def binary(keys: list[bytes]) -> pa.Array:
    return pa.array(keys, pa.binary())


def hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of a binary column without nulls."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, offsets, data = keys.buffers()
    off = np.frombuffer(offsets, np.int32)[keys.offset:keys.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return _HASH(raw, off[:-1], off[1:])


class PerfectHash:
    """``sizes``: 64-bit words of each level; ``bits``: the levels' words; ``keys``: in slot order,
    those kept aside last."""

    COLUMNS = "n long, sizes array<int>, bits binary, ends binary, keys binary"

    def __init__(self, sizes, bits: bytes, ends: bytes, keys: bytes):
        self.sizes = list(sizes)
        self.bits = np.frombuffer(bits, np.uint64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        placed = int(ones.sum())
        end = np.frombuffer(ends, np.int32)
        off = np.concatenate([np.zeros(1, np.int32), end])
        self.keys = pa.Array.from_buffers(pa.binary(), len(end), [None, pa.py_buffer(off), pa.py_buffer(keys)])
        self.aside = {k: placed + i for i, k in enumerate(self.keys[placed:].to_pylist())}

    def __len__(self):
        return len(self.keys)

    @staticmethod
    def build(keys: list[bytes], h: np.ndarray | None = None) -> tuple:
        """(n, sizes, bits, ends, keys) of distinct keys."""
        h = hashes(binary(keys)) if h is None else h
        left, sizes, words, order = np.arange(len(keys)), [], [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(1, int(len(left) * GAMMA) // 64 + 1)
            at = (mix(h[left] ^ _seed(len(sizes))) % np.uint64(size * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=size * 64) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            own = alone[at]
            order.append(left[own][np.argsort(at[own])])
            sizes.append(size)
            left = left[~own]
        order = np.concatenate([*order, left]) if len(keys) else left
        kept = [keys[i] for i in order.tolist()]
        ends = np.cumsum([len(k) for k in kept], dtype=np.int32) if kept else np.zeros(0, np.int32)
        bits = np.concatenate(words).tobytes() if words else b""
        return len(kept), sizes, bits, ends.astype(np.int32).tobytes(), b"".join(kept)

    def find(self, keys: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slots of the given strings, -1 where a string is not a key."""
        slot = np.full(len(h), -1, np.int64)
        left, first = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mix(h[left] ^ _seed(level)) % np.uint64(size * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + first, at & np.uint64(63)
            value = self.bits[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slot[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left, first = left[~hit], first + size
        hit = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[hit])), keys.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        slot[hit[~same]] = -1
        if self.aside:
            for i in np.flatnonzero(slot < 0).tolist():
                slot[i] = self.aside.get(keys[i].as_py(), -1)
        return slot
