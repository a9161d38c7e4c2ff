"""Word shingles as 64-bit hashes, computed with numpy over whole batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time; a single longer word is still hashed whole.
_PIECE = 1 << 19
#: Words of up to so many bytes are hashed by a table of random numbers for byte and place, longer ones each by BLAKE2b.
_SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each place and byte, so that the sum over a word's bytes is a hash without structure: no pattern of bytes cancels out.
_NUMBERS = mix(np.arange(1, _SHORT * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every run of bytes other than white space."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        x = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        inside = ~_SPACE[x]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = last - first
        # of each byte in a word its place there; those beyond a short word's length come from long ones, whose sums are replaced
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        total = np.zeros(len(place) + 1, dtype=np.uint64)
        np.cumsum(_NUMBERS[(np.minimum(place, _SHORT - 1) << 8) | x[inside]], out=total[1:])
        ends = np.cumsum(size)
        h = mix(total[ends] - total[ends - size] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(size > _SHORT).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[at + first[i] : at + last[i]], digest_size=8).digest(), "little")
        hashes.append(h)
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingles(text: bytes, size: int) -> set[bytes]:
    """The distinct shingles of a text themselves, by the rules of `shingle_sets`."""
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    Words are what stands between white space (0x20, 0x09-0x0D) after A-Z are lower-cased. A text of
    fewer than `size` words has one shingle, all its words; one without words has none.
    """
    data = b"\n".join(texts).lower()  # of bytes: ASCII letters only
    words, start = word_hashes(data)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    cut = np.searchsorted(start, begins)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        rolled = mix(rolled * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + w)
            yield h
        else:
            yield words[:0]
