"""Word shingles of whole texts as sets of 64-bit hashes, and their MinHash signatures."""

import hashlib

import numpy as np
import xxhash

from trajlens.llm.common import worker_memory

WORDS = 5
#: Words a worker remembers the hash of.
MEMO_WORDS = 250_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S29)) * _MIX
    return h ^ (h >> _S32)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.

    Words are runs without ASCII white space, A-Z lower-cased. With fewer
    words than a shingle has, all of them are one; a null text has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = worker_memory("word hashes")
    new = set(words).difference(known)
    if new:
        if len(known) > MEMO_WORDS:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        size = min(WORDS, len(words))
        out = np.full(len(words) - size + 1, np.uint64(size))
        for k in range(size):
            out = (out ^ h[k:len(h) - size + 1 + k]) * _PRIME
            out ^= out >> _S29
        return np.unique(_mixed(out))


def set_digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class MinHash:
    """Signatures of ``size`` coordinates; a coordinate's value is 32 bits."""

    def __init__(self, size: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.size = size
        self.flip = random.integers(0, 2 ** 64, size, dtype=np.uint64)
        self.factor = random.integers(0, 2 ** 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(shingles), 256):
                part = (shingles[at:at + 256, None] ^ self.flip) * self.factor
                np.minimum(out, part.min(0), out=out)
        return (out >> _S32).astype(np.uint32)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the common shingles reach ``percent`` times all shingles of both, in integers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    place = np.searchsorted(large, small)
    common = int((large[np.minimum(place, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
