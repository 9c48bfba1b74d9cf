"""Words of UTF-8 text and hashes of them and of runs of them (helper of the tasks).

Words are maximal runs of word bytes.  Every splitting rule used here treats all bytes from 0x80 up
alike, so working on UTF-8 bytes equals working on characters.  A word's hash is SipHash, as the interpreter
computes it (Spark gives all workers the same seed), or, where 128 bits are needed, its BLAKE2 digest.  A run's hash mixes
those of its two overlapping halves, level by level, so that neither words nor runs can be made up to have
equal hashes by solving equations.
"""

from __future__ import annotations

import os
from hashlib import blake2b

import numpy as np

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
#: Whether all workers compute the same SipHashes.
_SEEDED = os.environ.get("PYTHONHASHSEED", "random") != "random"
#: Words of at most LONGEST bytes that a worker remembers the digests of; the table starts anew when it is full.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes to lower case (A-Z), by default and with all bytes but letters, digits and those of non-ASCII characters as blanks.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing mixer on uint64 arrays (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(text: str | None, table: bytes | None = None) -> list[bytes]:
    """The words of a text, between space and 0x09-0x0D once its bytes went through the table; none of a null text."""
    raw = text.encode("utf-8", "replace") if text else b""
    return raw.translate(table).split() if table else raw.split()


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        digest = blake2b(word, digest_size=16).digest()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = digest
        return digest


_digests = _Digests()


def quick(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in all workers."""
    if not _SEEDED:
        return hashed(found)[:, 0].copy()
    return np.fromiter(map(hash, found), dtype=np.int64, count=len(found)).view(U64)


def hashed(found: list[bytes]) -> np.ndarray:
    """The digests of words: two numbers a row."""
    return np.frombuffer(b"".join(map(_digests.__getitem__, found)), U64).reshape(-1, 2)


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _ODD + y)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive rows, one for each start; columns are hashed apart."""
    if len(hashes) < size:
        return hashes[:0].copy()
    out, width = mix(hashes + U64(size)), 1
    while 2 * width <= size:
        out, width = _joined(out[: len(out) - width], out[width:]), 2 * width
    rest = size - width
    return _joined(out[: len(out) - rest], out[rest:]) if rest else out


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
