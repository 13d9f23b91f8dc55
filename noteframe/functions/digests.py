"""MD5 of many short texts at once, as arrays, inside a task.

Equal to SQL's ``md5``. Draws hash each key once per few replicates, so the digests are most of
their time; here an operation works on a batch of texts instead of one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_SHIFTS = [*[7, 12, 17, 22] * 4, *[5, 9, 14, 20] * 4, *[4, 11, 16, 23] * 4, *[6, 10, 15, 21] * 4]
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_CHUNK = 1 << 13


def _mixed(words: np.ndarray, state: list[np.ndarray]) -> list[np.ndarray]:
    """The state after a block of 16 words (16, n)."""
    a, b, c, d = state
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _ADDED[i]
        f += words[_PLACES[i]]
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        f <<= np.uint32(_SHIFTS[i])
        f |= t
        a, d, c, b = d, c, b, f + b
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


class Texts:
    """Texts without nulls as rows of bytes, to be hashed behind several beginnings."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.lengths = np.diff(offsets)
        self.bytes = np.zeros((len(texts), int(self.lengths.max(initial=0))), np.uint8)
        inside = np.arange(self.bytes.shape[1]) < self.lengths[:, None]
        self.bytes[inside] = data[offsets[0] : offsets[-1]] if len(texts) else 0

    def md5(self, first: str | Sequence[str], which: np.ndarray | None = None) -> np.ndarray:
        """(n, 16) bytes of the digests of ``first`` and the texts; ``which`` names each one's ``first``."""
        firsts = [first.encode()] if isinstance(first, str) else [v.encode() for v in first]
        which = np.zeros(len(self.lengths), np.int64) if which is None else which
        sizes = np.array([len(v) for v in firsts], np.int64)
        out = np.zeros((len(self.lengths), 16), np.uint8)
        blocks = (sizes[which] + self.lengths + 8) // 64 + 1
        shape = sizes[which] * (int(blocks.max(initial=0)) + 1) + blocks
        for kind in np.unique(shape):  # rows of one length of ``first`` and one number of blocks
            rows = (shape == kind).nonzero()[0]
            n, p = int(blocks[rows[0]]), int(sizes[which[rows[0]]])
            table = np.array([np.frombuffer(v.ljust(p)[:p], np.uint8) for v in firsts]).reshape(len(firsts), p)
            width = min(self.bytes.shape[1], 64 * n - p - 9)
            for at in range(0, len(rows), _CHUNK):
                some = rows[at : at + _CHUNK]
                told = np.zeros((len(some), 64 * n), np.uint8)
                told[:, :p] = table[which[some]]
                told[:, p : p + width] = self.bytes[some, :width]
                ends = p + self.lengths[some]
                told[np.arange(len(some)), ends] = 0x80
                told[:, -8:] = (8 * ends).astype("<u8").view(np.uint8).reshape(-1, 8)
                words = np.ascontiguousarray(told.view("<u4").T).astype(np.uint32)
                state = [np.full(len(some), v, np.uint32) for v in _START]
                for block in range(n):
                    state = _mixed(words[16 * block : 16 * block + 16], state)
                out[some] = np.stack(state, 1).astype("<u4").view(np.uint8)
        return out
