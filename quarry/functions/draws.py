"""The draws of functions.columns.draw for many points of a scene at once, as NumPy arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
WORDS = [(k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16 for k in range(64)]
SINES = [int(abs(math.sin(k + 1)) * (1 << 32)) for k in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The longest message that MD5 looks at in one block.
BLOCK = 55


def _first_words(m: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 digests of one-block messages: rows of m (uint32) are their words up to the mark, sizes their bits."""
    shape = m.shape[1:]
    a, b, c, d = (np.full(shape, s, np.uint32) for s in START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for k in range(61):  # the first word is ready then
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(SINES[k])
        if WORDS[k] < len(m):
            f += m[WORDS[k]]
        if WORDS[k] == 14:
            f += sizes
        np.left_shift(f, np.uint32(SHIFTS[k]), out=g)
        f >>= np.uint32(32 - SHIFTS[k])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(START[0])
    return b.byteswap()


def point_digits(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points' numbers as text in rows of bytes, ended by MD5's mark, and how many digits they have."""
    texts = [str(p).encode() for p in points.tolist()]
    sizes = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join((t + b"\x80").ljust(sizes.max() + 1, b"\0") for t in texts), np.uint8).reshape(len(texts), -1), sizes


def draws(seed: int, names: list[str], scene, digits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """draw(seed, name, scene, point) of each name (none: '') and point, as doubles in rows by name."""
    text, sizes = digits
    firsts = ["|".join((str(seed), name, str(scene), "") if name else (str(seed), str(scene), "")).encode() for name in names]
    longest = int(max(map(len, firsts)) + sizes.max())
    if longest > BLOCK:
        return np.array([[int.from_bytes(hashlib.md5(first + t[:n].tobytes()).digest()[:4]) for t, n in zip(text, sizes.tolist())] for first in firsts], float)
    block = np.zeros((len(names), len(text), longest // 4 * 4 + 4), np.uint8)
    for own, first in zip(block, firsts):
        own[:, : len(first)] = np.frombuffer(first, np.uint8)
        own[:, len(first) : len(first) + text.shape[1]] = text
    bits = ((np.array([len(first) for first in firsts])[:, None] + sizes) * 8).astype(np.uint32)
    return _first_words(np.ascontiguousarray(np.moveaxis(block.view("<u4"), 2, 0)), bits).astype(float)


def uniforms(seed: int, names: list[str], scene, digits: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """synthesis.uniform(name, 0, 1, seed, scene, point) of each name and point."""
    return dict(zip(names, (draws(seed, names, scene, digits) + 0.5) / float(1 << 32)))


def of_scene(name: str, low: float, high: float, seed: int, scene) -> float:
    """synthesis.uniform(name, low, high, seed, scene)."""
    number = int.from_bytes(hashlib.md5(f"{seed}|{name}|{scene}".encode()).digest()[:4])
    return low + (high - low) * (number + 0.5) / float(1 << 32)
