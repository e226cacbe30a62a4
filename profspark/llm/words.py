"""Words of UTF-8 texts and their 64-bit hashes, in numpy.

A word's hash is the sum of a random number per byte times a power of an odd base, modulo 2**64, and then mixed. Sums
over a run of bytes are differences of running sums, so that a whole text takes a few array operations. Texts are read
in pieces, which bounds memory at about 40 bytes per byte of a piece plus 24 bytes per word.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

U64 = np.uint64
PIECE = 1 << 17
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class Alphabet(NamedTuple):
    """What separates words, and a number for each byte (the same for A-Z and a-z where case is folded)."""

    separator: np.ndarray
    value: np.ndarray
    table: bytes


def alphabet(is_word, fold: bool = True) -> Alphabet:
    """is_word says of a byte (after folding) whether words hold it; all bytes of non-ASCII characters are passed, too."""
    folded = [b + 32 if fold and 65 <= b <= 90 else b for b in range(256)]
    digest = b"".join(hashlib.blake2b(bytes([b]), digest_size=8, key=b"words").digest() for b in range(256))
    value = np.frombuffer(digest, dtype=U64)[folded]
    separator = np.array([not is_word(b) for b in folded])
    table = bytes(32 if separator[b] else folded[b] for b in range(256))
    return Alphabet(separator, value, table)


#: Runs of anything but ASCII white space.
SPACED = alphabet(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Runs of ASCII letters, digits and all other characters beyond ASCII.
ALNUM = alphabet(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Runs of ASCII letters and all characters beyond ASCII; texts come in lower case.
LETTERS = alphabet(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(PIECE + 1, base, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over all others (the finalizer of MurmurHash3)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def words(data: bytes, kind: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in bytes) of each word. Words may be longer than a piece."""
    power, inverse = _powers()
    hashes, starts, ends = [], [], []
    open_at, open_hash = -1, 0
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data, dtype=np.uint8, count=min(PIECE, len(data) - at), offset=at)
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = ~kind.separator[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(b) + 1, dtype=U64)
        np.cumsum(kind.value[b] * power[: len(b)], out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        start, end = start + at, end + at
        if open_at >= 0:
            if len(start) and start[0] == at:
                h[0] = U64((open_hash + int(h[0]) * pow(BASE, at - open_at, 1 << 64)) & MASK)
                start[0] = open_at
            else:
                h, start, end = np.insert(h, 0, U64(open_hash)), np.insert(start, 0, open_at), np.insert(end, 0, at)
            open_at = -1
        if len(end) and end[-1] == at + len(b) and end[-1] < len(data):
            open_at, open_hash = int(start[-1]), int(h[-1])
            h, start, end = h[:-1], start[:-1], end[:-1]
        hashes.append(h)
        starts.append(start)
        ends.append(end)
    if not hashes:
        none = np.empty(0, dtype=np.int64)
        return none.astype(U64), none, none
    if len(hashes) == 1:
        return mix(hashes[0]), starts[0], ends[0]
    return mix(np.concatenate(hashes)), np.concatenate(starts), np.concatenate(ends)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= U64(BASE)
        out += hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Runs of `size` words; of fewer words, but not none, the whole sequence as one."""
    return windows(hashes, min(size, len(hashes))) if len(hashes) else hashes


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
