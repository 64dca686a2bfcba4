"""Words as byte strings, and their hashes, for operators that work in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Every ASCII byte that isn't a digit or letter becomes a space; A-Z become a-z. Bytes over 0x7F stay.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8: A-Z lower-cased, cut at every ASCII character but digits and letters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


#: ASCII white space becomes a space; A-Z become a-z. All other bytes stay.
_SPACED_BYTES = bytes(0x20 if b in b"\t\n\v\f\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SLICE_BYTES, _LONG_WORD = 1 << 16, 64
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    out = np.full(_SLICE_BYTES, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _slice_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of at most _SLICE_BYTES bytes: the sum of a word's bytes times powers of
    an odd base, from one running sum over all bytes (arithmetic is modulo 2**64, so exact), mixed
    with the word's length. Long words are hashed one by one."""
    letters = np.frombuffer(data, np.uint8)
    inside = letters != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.empty(len(letters) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(letters * _UP[: len(letters)], out=sums[1:])
    out = mixed((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(end - start > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def _hashes(data: bytes) -> np.ndarray:
    if len(data) <= _SLICE_BYTES:
        return _slice_hashes(data)
    parts, at = [], 0
    while at < len(data):
        cut = len(data) if len(data) - at <= _SLICE_BYTES else data.rfind(b" ", at, at + _SLICE_BYTES)
        if cut > at or data[at : at + 1] == b" ":
            parts.append(_slice_hashes(data[at:cut]))
            at = max(cut, at + 1)
        else:  # a word longer than a slice
            cut = data.find(b" ", at)
            cut = len(data) if cut < 0 else cut
            parts.append(np.array([xxhash.xxh3_64_intdigest(data[at:cut])], np.uint64))
            at = cut
    return np.concatenate(parts)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words that words_of gives, in order."""
    return _hashes(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES))


def spaced_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's words, A-Z lower-cased, cut at ASCII white space only."""
    return _hashes(text.encode("utf-8", "surrogatepass").translate(_SPACED_BYTES))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (two multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of each n words that follow one another, scrambled."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mixed(out)
