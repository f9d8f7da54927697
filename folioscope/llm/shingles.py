"""Word shingles, MinHash samples, band keys and odd sketches of whole batches of texts, in numpy.

Words are hashed by a polynomial over their bytes, shingles by a combination of their words' hashes;
both are 64 bits and mixed, so that equal hashes stand for equal words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that go through the arrays together.
CHUNK = 1 << 18

_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 4096), base, _U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(texts: list[bytes], size: int = CHUNK):
    """Ranges of texts of about ``size`` bytes together."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the place of each text's first word, with the end behind."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined.translate(table), np.uint8)
    inside = data != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, _U), first
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power(_BASE, len(data))[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * power(_INVERSE, len(data))[starts]), first


_MULTIPLIERS = mix(np.arange(1, 65, dtype=_U) * _U(_BASE)) | _U(1)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, repeated ones included; a shorter text is one shingle."""
    size = np.diff(first)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    place = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=place[1:])
    at = np.arange(place[-1]) - np.repeat(place[:-1], count) + np.repeat(first[:-1], count)
    end = np.repeat(first[1:], count)
    padded = np.concatenate((hashes, np.zeros(k, _U)))
    out = np.zeros(len(at), _U)
    for j in range(k):
        out += np.where(at + j < end, padded[at + j], _U(j + 1)) * _MULTIPLIERS[j]
    return mix(out), place


class Sketcher:
    """MinHash samples folded into band keys and an odd sketch."""

    def __init__(self, bands: int, rows: int, bits: int = 256):
        self.bands, self.rows, self.bits, self.k = bands, rows, bits, bands * rows
        seeds = mix(np.arange(1, 2 * self.k + 1, dtype=_U) * _U(0xD1342543DE82EF95))
        self.factor = (seeds[: self.k] >> _U(32)).astype(np.uint32) | np.uint32(1)
        self.shift = (seeds[self.k :] >> _U(32)).astype(np.uint32)

    def samples(self, found: np.ndarray, place: np.ndarray) -> np.ndarray:
        """k x texts; texts without shingles get the greatest value."""
        out = np.full((self.k, len(place) - 1), np.iinfo(np.uint32).max, np.uint32)
        filled = np.flatnonzero(np.diff(place))
        if len(filled):
            x = (found >> _U(32)).astype(np.uint32)
            cut = place[filled]
            for j in range(self.k):
                out[j, filled] = np.minimum.reduceat(x * self.factor[j] + self.shift[j], cut)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """Band keys, texts x bands, as signed 64-bit numbers."""
        grouped = samples.reshape(self.bands, self.rows, -1).astype(_U)
        out = np.repeat(np.arange(1, self.bands + 1, dtype=_U)[:, None], samples.shape[1], 1)
        for r in range(self.rows):
            out = mix(out * _U(_BASE) + grouped[:, r])
        return np.ascontiguousarray(out.T).view(np.int64)

    def odd(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmaps, texts x (bits / 64): each sample toggles the bit that it hashes to."""
        n = samples.shape[1]
        slot = mix(samples.astype(_U) + (np.arange(1, self.k + 1, dtype=_U) << _U(32))[:, None]) % _U(self.bits)
        flat = slot.astype(np.int64) + self.bits * np.arange(n)[None, :]
        parity = (np.bincount(flat.ravel(), minlength=n * self.bits) & 1).astype(np.uint8).reshape(n, self.bits)
        return np.packbits(parity, axis=1).view(np.int64)

    def similarity(self, differing: float) -> float:
        """Estimate of the Jaccard similarity from the population count of two sketches' XOR."""
        rest = 1 - 2 * differing / self.bits
        return 1 + self.bits / (4 * self.k) * float(np.log(rest)) if rest > 0 else 0.0

    def most_bits(self, threshold: float, deviations: float = 6.0) -> int:
        """XOR population count that a pair of that similarity exceeds with negligible probability."""
        spread = (threshold * (1 - threshold) / self.k) ** 0.5
        low = max(0.0, threshold - deviations * spread)
        expected = self.bits / 2 * (1 - (1 - 2 / self.bits) ** (2 * self.k * (1 - low)))
        return int(np.ceil(expected + 3 * (self.bits * 0.25 * (1 - low)) ** 0.5))
