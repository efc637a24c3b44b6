"""Word shingles as sorted 64-bit hash sets, and HyperMinHash sketches of them.

A document's words are the maximal runs outside ``[\\x20\\x09-\\x0D]`` after A-Z became a-z; its
set holds the distinct five-word shingles, or the whole sequence as one shingle when it has fewer
words.  Sets are kept as sorted unique uint64 hashes, so an intersection is one merge.

The sketch is HyperMinHash with stochastic averaging: the top bits of a shingle's hash name one of
``BUCKETS`` registers, and a register keeps the smallest remaining value of its bucket compressed
to the count of leading zeros (6 bits) and the ``MANTISSA`` bits after the first one.  As the set
is sorted, the minimum of a bucket is simply the first hash at or above the bucket's lower bound.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BAND_ROWS = 4
BANDS = BUCKETS // BAND_ROWS
#: Words remembered per worker before the cache is emptied, and the longest that are (bounds its memory, not the result).
CACHE_WORDS, CACHE_BYTES = 200_000, 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_K = np.uint64(0x9E3779B97F4A7C15)
_REST_BITS = 64 - BUCKET_BITS
_BOUNDS = (np.arange(BUCKETS + 1, dtype=object) << _REST_BITS)
_BOUNDS[-1] -= 1
_BOUNDS = _BOUNDS.astype(np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_cache = _WordHashes()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text; bytes.split() without arguments cuts at exactly [\\x20\\x09-\\x0D]."""
    return text.translate(_LOWER).split()


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty without words."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(_cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - SHINGLE_WORDS + 1
    out = h[:n].copy()
    for i in range(1, SHINGLE_WORDS):
        out *= _K
        out ^= out >> np.uint64(29)
        out += h[i : i + n]
    out = mix64(out)
    out.sort()
    if n > 1:
        keep = np.empty(n, dtype=bool)
        keep[0] = True
        np.not_equal(out[1:], out[:-1], out=keep[1:])
        out = out[keep]
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The BUCKETS registers (uint16) of a sorted set; 0 marks an empty bucket."""
    at = np.searchsorted(hashes, _BOUNDS[:-1])
    full = at < len(hashes)
    first = hashes[np.where(full, at, 0)] if len(hashes) else np.zeros(BUCKETS, dtype=np.uint64)
    full &= (first >> np.uint64(_REST_BITS)) == np.arange(BUCKETS, dtype=np.uint64)
    value = (first << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    top = np.frexp(value.astype(np.float64))[1] - 1  # place of the leading one
    # A value that rounds up to the next power of two in float64 has all mantissa bits set.
    top = np.minimum(top, 63)
    top -= ((value >> top.astype(np.uint64)) == 0)
    zeros = (63 - top).astype(np.uint64)
    mantissa = ((value << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    code = (np.minimum(zeros + np.uint64(1), np.uint64(63)) << np.uint64(MANTISSA)) | mantissa
    return np.where(full, code, 0).astype(np.uint16)


def _probe_table() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)]).astype(np.int64)


_PROBES = _probe_table()


def densify(regs: np.ndarray) -> np.ndarray:
    """Fill the empty registers of each row (n, BUCKETS) from the first full bucket of the
    register's own seeded probe sequence, so that small sets keep the collision rate J."""
    out = regs.copy()
    row, col = np.nonzero(regs == 0)
    live = (regs != 0).any(axis=1)
    keep = live[row]
    row, col = row[keep], col[keep]
    step = 0
    while len(row):
        probe = _PROBES[col, step]
        got = regs[row, probe]
        # The probed bucket is part of the value: two sets agree only if they borrow alike.
        done = got != 0
        out[row[done], col[done]] = got[done]
        row, col = row[~done], col[~done]
        step += 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(n, BANDS) int64 keys of bands of BAND_ROWS densified registers."""
    packed = np.ascontiguousarray(densify(regs)).view(np.uint64)
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _K)
    return mix64(packed ^ salt).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows a and b (broadcast against each other).

    Two different minima share a register when both fall into one cell of width about x / 2**MANTISSA
    at depth x; integrating over exponential minima of both sets gives the expected number of
    accidental matches, which is taken off before dividing by the registers that either set fills.
    """
    same = ((a == b) & (a != 0)).sum(axis=-1).astype(np.float64)
    filled = ((a | b) != 0).sum(axis=-1).astype(np.float64)
    n_a, n_b = np.asarray(n_a, dtype=np.float64), np.asarray(n_b, dtype=np.float64)
    chance = filled * (0.7213 / (1 << MANTISSA)) * n_a * n_b / np.maximum((n_a + n_b) ** 2, 1.0)
    chance *= 1.0 - same / np.maximum(filled, 1.0)
    return np.clip((same - chance) / np.maximum(filled, 1.0), 0.0, 1.0)
