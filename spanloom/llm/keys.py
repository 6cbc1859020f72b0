"""Words, shingle hashes and fixed-size count sketches, vectorised with NumPy for Arrow batches.

A *word* is a maximal run of Unicode letters and numbers in the lower-cased text. A *shingle* is a run of
``width`` words, represented by a 64-bit hash of its words' 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_CACHE_LIMIT = 400_000
_cache: dict[str, int] = {}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def word_hashes(found: list[str]) -> np.ndarray:
    """64-bit hashes of words; a bounded per-process cache saves rehashing common ones."""
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """Invertible avalanche on 64-bit lanes."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def window_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes; empty if there are fewer words."""
    n = len(w) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = w[:n].copy()
    for k in range(1, width):
        h = h * _U(0x9FB21C651E98DF25) + w[k : k + n]
    return mix(h)


def signature(sorted_set: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set; texts with equal sets share it."""
    return int(np.int64(_U(xxhash.xxh3_64_intdigest(sorted_set.tobytes()))))


def sketch_slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each hash in a sketch of 2 ** bits counters (first and second half)."""
    half = _U((1 << (bits - 1)) - 1)
    return (h & half).astype(np.int64), ((h >> _U(32)) & half).astype(np.int64) + (1 << (bits - 1))


class Sketch:
    """A count sketch of fixed size. It never counts a hash too low, so a total order by (estimate, hash) is
    the same on every machine, and 1 means that the hash was counted once."""

    def __init__(self, bits: int, counts: np.ndarray | None = None) -> None:
        self.bits = bits
        self.counts = np.zeros(1 << bits, np.int64) if counts is None else counts

    def add(self, h: np.ndarray) -> None:
        for slots in sketch_slots(h, self.bits):
            self.counts += np.bincount(slots, minlength=len(self.counts))

    def estimate(self, h: np.ndarray) -> np.ndarray:
        a, b = sketch_slots(h, self.bits)
        return np.minimum(self.counts[a], self.counts[b])

    def excess(self, h: np.ndarray) -> np.ndarray:
        """The estimate without the mean load of a counter. A full sketch gives every hash a high estimate, but only hashes that are
        far more common than the rest have an excess, so what is done for them stays rare at any size of the corpus."""
        return self.estimate(h) - int(self.counts[: 1 << (self.bits - 1)].mean())

    def chunks(self, size: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(0, len(self.counts), size):
            if (part := self.counts[k : k + size]).any():
                yield k // size, part


def sketch_size(words: int, least: int = 18, most: int = 24) -> int:
    """Bits of a sketch for a corpus of so many words: some 32 to a counter, as long as the sketch stays within 2 ** ``most`` counters (64 MB)."""
    return min(most, max(least, (max(words, 1) // 32).bit_length() + 1))


def bitmap_size(hashes: int, least: int = 18, most: int = 28) -> int:
    """Bits of a bitmap for so many hashes: 8 to 16 of them to each hash, as long as it stays within 2 ** ``most`` bits (32 MB)."""
    return min(most, max(least, (8 * max(hashes, 1)).bit_length()))


def deal(gram: np.ndarray, own: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of entries of hot columns, self-joined: each entry, in part ``own`` of its column's ``parts``, goes to the block of each pair of
    parts that it belongs to. Gives (index of the entry, block), block a 62-bit number of column and pair."""
    at = np.repeat(np.arange(len(gram)), parts)
    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo, hi = np.minimum(own[at], other), np.maximum(own[at], other)
    block = mix(gram[at] + mix((lo.astype(np.uint64) << _U(32)) + hi.astype(np.uint64) + _U(1)))
    return at, (block >> _U(2)).astype(np.int64)


def bin_bits(rows: int, per_bin: int = 4096, least: int = 4, most: int = 20) -> int:
    """Bits of a random key that divide so many rows into bins of about ``per_bin``."""
    return min(most, max(least, (rows // per_bin).bit_length()))


def arrow_rows(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Rows of Arrow record batches as tuples of Python values, a thousand at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
