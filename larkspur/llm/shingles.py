"""Hashed word shingles of texts, on whole arrays."""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = powers(BASE, CHUNK + 1), powers(INVERSE, CHUNK + 1)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of bytes that are not white space, and where it starts."""
    hashes, places, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while low < len(text):
        high = min(len(text), low + CHUNK)
        if high < len(text):  # not within a word, unless it is longer than a chunk
            cut = max(text.rfind(b, low, high) for b in (b" ", b"\n", b"\t", b"\r"))
            high = cut + 1 if cut > low else high
        buf = np.frombuffer(text, np.uint8, high - low, low)
        blank = (buf == 32) | (buf - np.uint8(9) < 5)  # white space of ASCII
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # of words, in turn where one starts and where it ends
        edge = np.concatenate([[0][: not blank[0]], edge, [len(buf)][: not blank[-1]]]).astype(np.int64)
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(buf) + 1, np.uint64)
        terms = buf.astype(np.uint64)
        terms += np.uint64(1)
        terms *= POWERS[: len(buf)]
        np.cumsum(terms, out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * INVERSES[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + low)
        low = high
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(items: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words than size has one of all its words, a blank text none."""
    out: list[np.ndarray] = []
    step = np.uint64(0xD6E8FEB86659FD93)

    def add(words: np.ndarray, counts: np.ndarray) -> None:
        total = np.zeros(len(words), np.uint64)
        for j in range(size):
            total[: len(words) - j] = total[: len(words) - j] * step + words[j:]
        total = mixed(total)
        for end, n in zip(np.cumsum(counts), counts, strict=True):
            if n >= size:
                out.append(np.unique(total[end - n : end - size + 1]))
            elif n:
                one = np.zeros(1, np.uint64)
                for w in words[end - n : end]:
                    one = one * step + w
                out.append(mixed(one + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))

    waiting: list[bytes] = []

    def flush() -> None:
        if waiting:
            starts = np.cumsum([0, *[len(t) + 1 for t in waiting]])
            words, places = word_hashes(b"\n".join(waiting))
            add(words, np.diff(np.searchsorted(places, starts)))
            waiting.clear()

    size_of = 0
    for text in items:
        if size_of + len(text) + 1 > CHUNK:
            flush()
            size_of = 0
        waiting.append(text)
        size_of += len(text) + 1
    flush()
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minhashes(sets: list[np.ndarray], n: int, seed: int = 3) -> np.ndarray:
    """n minimum hashes of 32 bits for each set (all ones for an empty one)."""
    rng = np.random.default_rng(seed)
    turn, shift = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        low = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        for k in range(n):
            x = low * turn[k] + shift[k]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(15)
            out[some, k] = np.minimum.reduceat(x, starts)
    return out
