"""Five-word shingles of texts as sorted weighted sets, and improved consistent weighted samples of them."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tallyspring.llm.words import row_sums, words

WORDS = 5
#: Bits of a shingle's hash. The number of a text in its slice stands above them while the slice is sorted.
BITS = 50
MASK = np.uint64((1 << BITS) - 1)
MOST_ROWS = 1 << 13
#: A weight is kept as the nearest power of this, which is within 2 %.
STEP = 1.04
#: Parts of the hash that choose a shingle's random numbers.
PART = 1 << 12


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Shingled:
    """Of a slice of texts: the distinct shingles of each in rising order, in a row; how often each occurs in its text;
    offsets of the texts; two 64-bit digests of each text's words in order; its number of words."""

    hashes: np.ndarray
    times: np.ndarray
    offsets: np.ndarray
    digests: tuple[np.ndarray, np.ndarray]
    n_words: np.ndarray


def shingled(texts: pa.Array) -> Shingled:
    """Words are runs between ASCII blanks, in lower case. A text of one to four words has one shingle of all of them."""
    if len(texts) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} texts")
    offsets, codes, distinct = words(pc.utf8_lower(texts))
    w = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct), np.uint64, len(distinct))[codes]
    n = np.diff(offsets)
    place = np.arange(len(w)) - np.repeat(offsets[:-1], n)
    at = place.astype(np.uint64)
    digests = (row_sums(mixed(w + at * np.uint64(0x9E3779B97F4A7C15)), offsets), row_sums(mixed(w ^ mixed(at + np.uint64(77))), offsets))
    rolled = np.zeros(len(w), np.uint64)
    for j in range(WORDS):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + np.roll(w, -j)
    valid = place + WORDS <= np.repeat(n, n)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    rolled[offsets[short]] = digests[0][short]
    valid[offsets[short]] = True
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    keys = np.sort((row[valid] << np.uint64(BITS)) | (mixed(rolled[valid]) >> np.uint64(64 - BITS)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    ends = np.searchsorted(keys, np.arange(1, len(n) + 1, dtype=np.uint64) << np.uint64(BITS))
    return Shingled(keys & MASK, times, np.concatenate([[0], ends]).astype(np.int64), digests, n)


#: The least part of its weight that a frequent shingle keeps, and the most that repeats inside a text add.
FLOOR, GAIN = 0.8, 0.25
#: Shingles in at most this share of all documents count as rare, alike at every number of documents.
RARE = 1e-3


def levels(times: np.ndarray, share: np.ndarray, n_documents: float) -> np.ndarray:
    """Damped TF-IDF weights, tf * (FLOOR + (1 - FLOOR) * idf), as powers of ``STEP``.

    ``idf`` is ln(1 + 1 / share), with a rare shingle's as 1; ``tf`` is 1 + GAIN * (1 - 1 / (1 + ln times)). Both are
    damped so that a large group of near copies, whose own shingles are frequent for that reason, still is one, and that
    texts which differ in how often they repeat a line stay near.
    """
    rare = max(RARE, 1 / max(n_documents, 1))
    idf = np.log1p(1 / np.maximum(share, rare)) / np.log1p(1 / rare)
    weight = (1 + GAIN * (1 - 1 / (1 + np.log(times)))) * (FLOOR + (1 - FLOOR) * idf)
    return np.rint(np.log(weight) / np.log(STEP)).astype(np.int64)


class Sampler:
    """Improved consistent weighted sampling: of each weighted set, for every k, the least
    ln a = ln c - r * (t - b + 1) over its members, with t = floor(ln w / r + b), r and c from Gamma(2, 1), b uniform.

    Two sets agree in a sample with the probability of their weighted Jaccard similarity. A sample is kept as the bits
    of its ln a: it tells the member and its t. Part of a member's hash chooses its r and b, another part its c, out of
    tables that are small enough for the processor's cache.
    """

    def __init__(self, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k = k
        self.r, self.b = rng.gamma(2, 1, (PART, k)), rng.uniform(0, 1, (PART, k))
        self.ln_c = np.log(rng.gamma(2, 1, (PART, k))).astype(np.float32)
        self.known: dict[int, int] = {}
        self.table = np.zeros((0, k), np.float32)

    def level(self, level: int) -> int:
        """Where the table of a weight's -r * (t - b + 1) starts."""
        if level not in self.known:
            t = np.floor(level * np.log(STEP) / self.r + self.b)
            self.known[level] = len(self.table)
            self.table = np.concatenate([self.table, (-self.r * (t - self.b + 1)).astype(np.float32)])
        return self.known[level]

    def samples(self, hashes: np.ndarray, level: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
        """uint32 samples by text and k; texts without members have zeros."""
        out = np.zeros((len(offsets) - 1, self.k), np.uint32)
        distinct, code = np.unique(level, return_inverse=True)
        starts = np.array([self.level(int(x)) for x in distinct], np.int64)
        a = (hashes & np.uint64(PART - 1)).astype(np.int64) + (starts[code] if len(code) else 0)
        c = ((hashes >> np.uint64(12)) & np.uint64(PART - 1)).astype(np.int64)
        best = np.full((len(offsets) - 1, self.k), np.inf, np.float32)
        row, at = 0, 0
        while at < len(hashes):
            to = min(at + chunk, len(hashes))
            values = self.table[a[at:to]]
            values += self.ln_c[c[at:to]]
            rows = np.unique(np.searchsorted(offsets, np.arange(at, to), "right") - 1) if to - at < 64 else np.arange(np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to - 1, "right"))
            rows = rows[offsets[rows + 1] > offsets[rows]]
            begins = np.maximum(offsets[rows], at) - at
            best[rows] = np.minimum(best[rows], np.minimum.reduceat(values, begins, axis=0))
            at = to
        full = offsets[1:] > offsets[:-1]
        out[full] = best[full].view(np.uint32).reshape(-1, self.k)
        return out


@functools.cache
def sampler(k: int) -> Sampler:
    return Sampler(k)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets, each as sorted hashes and weights."""
    total = float(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 0.0
