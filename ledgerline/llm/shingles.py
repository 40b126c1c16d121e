"""Word shingles as 64-bit hashes, for whole batches of texts at once.

Words are maximal runs without ASCII white space after lower-casing A-Z. A shingle's hash mixes the 64-bit hashes of
its words with a constant for each place, so a set of n shingles has a chance of about n * n / 2**65 to lose one to a
collision. Texts with fewer words than a shingle has are one shingle; texts without words have none.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Shingler:
    def __init__(self, width: int = 5, cache_size: int = 200_000):
        if not 1 <= width <= len(PLACES):
            raise ValueError(f"width must be 1 to {len(PLACES)}")
        self.width, self.cache_size, self.words = width, cache_size, WordHashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct shingle hashes of each text, sorted."""
        split = [split_words(t) for t in texts]
        if len(self.words) > self.cache_size:
            self.words.clear()
        total = sum(map(len, split))
        w = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.uint64, total)
        k = self.width
        if total >= k:
            h = w[: total - k + 1] * PLACES[0]
            for j in range(1, k):
                h += (w[j : total - k + 1 + j] ^ (w[j : total - k + 1 + j] >> np.uint64(31))) * PLACES[j]
            h = mix(h)
        out, at = [], 0
        for words in split:
            n = len(words)
            if n >= k:
                s = np.sort(h[at : at + n - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
            elif n:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


class Minima:
    """Minima of universal hash functions (a * x + b mod 2^32, a odd) over shingle sets, and hashes of their bands."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        n = bands * rows
        self.a = r.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 2**32, n, np.uint32)
        self.bands, self.rows = bands, rows

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        sig = None
        for k in range(0, len(x), 1024):
            part = (np.multiply.outer(self.a, x[k : k + 1024]) + self.b[:, None]).min(1)
            sig = part if sig is None else np.minimum(sig, part)
        return sig

    def buckets(self, sig: np.ndarray) -> list[int]:
        """A 64-bit bucket for each band; the band's number is part of it."""
        rows = sig.reshape(self.bands, self.rows)
        return [xxhash.xxh3_64_intdigest(rows[i].tobytes(), seed=i) - 2**63 for i in range(self.bands)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
