"""MD5 of many short texts that differ in a counter only, in numpy."""

from __future__ import annotations

from math import sin

import numpy as np

ROTATIONS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
SINES = [int(abs(sin(i + 1)) * 2 ** 32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# Texts of one step: its arrays stay in a core's cache.
STEP = 8192
# Bytes of a text that fits one MD5 block.
LONGEST = 55


def counter_digests(prefix: bytes, first: int, last: int) -> np.ndarray:
    """Digests of `prefix` and each number of first..last-1 in decimals, all of the same length, as rows of four words."""
    numbers = np.arange(first, last, dtype=np.int64)
    width = len(str(last - 1))
    block = bytearray(64)
    block[:len(prefix)] = prefix
    block[len(prefix) + width] = 0x80
    block[56:64] = (8 * (len(prefix) + width)).to_bytes(8, "little")
    fixed = [int.from_bytes(block[4 * i:4 * i + 4], "little") for i in range(16)]
    changing: dict[int, np.ndarray] = {}
    for k in range(width):
        at = len(prefix) + k
        digit = (numbers // 10 ** (width - 1 - k) % 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
        changing[at // 4] = changing[at // 4] | digit if at // 4 in changing else digit
    a, b, c, d = (np.full(len(numbers), word, np.uint32) for word in START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            word = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            word = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            word = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            word = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        a += np.uint32((SINES[i] + fixed[word]) % 2 ** 32)
        if word in changing:
            a += changing[word]
        np.left_shift(a, np.uint32(ROTATIONS[i]), out=f), np.right_shift(a, np.uint32(32 - ROTATIONS[i]), out=g)
        np.bitwise_or(f, g, out=a)
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(word) for x, word in zip((a, b, c, d), START)], axis=1)
