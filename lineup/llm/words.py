"""Words of whole texts as arrays: borders and 64-bit hashes, many texts at once.

Texts are UTF-8 bytes put one after another.  Every byte that ends a word is
mapped to the newline, so a word is a maximal run of other bytes; bytes above
0x7F always belong to words.  A word's hash is a polynomial of its bytes modulo
2**64, taken from one running sum over the whole buffer, then mixed.  Equal
words have equal hashes on every machine; callers that need certainty compare
the bytes of what the hashes bring together.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
#: Words are runs of anything but ASCII white space, unchanged.
SPACED = bytes(10 if b in _SPACE else b for b in range(256))
#: The same with A-Z lower-cased.
SPACED_LOWER = bytes(10 if b in _SPACE else _LOWER[b] for b in range(256))
#: Words are runs of ASCII letters (A-Z lower-cased), digits and all non-ASCII bytes.
ALNUM_LOWER = bytes(_LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 10
                    for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Bytes that are hashed at once; bounds the memory for a very long text.
CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        _POWERS[:] = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base & (2 ** 64 - 1), np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def range_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial of the values of each range, the same wherever a range lies; ``lo`` and ``hi`` ascend."""
    out = np.empty(len(lo), np.uint64)
    at = 0
    while at < len(lo):
        base = lo[at]
        stop = max(at + 1, int(np.searchsorted(hi, base + CHUNK, side="right")))
        part = values[base:hi[stop - 1]]
        power, inverse = _powers(len(part))
        total = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)])
        a, b = lo[at:stop] - base, hi[at:stop] - base
        before = np.where(a > 0, total[a - 1], np.uint64(0))
        out[at:stop] = (total[b - 1] - before) * inverse[a]
        at = stop
    return out


class Words:
    """Words of a list of texts: ``start``/``end`` in ``data``, ``first`` word of each text, ``hash``."""

    def __init__(self, texts: list[bytes | None], table: bytes):
        parts = [t or b"" for t in texts]
        self.data = b"\n".join(parts).translate(table) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        word = buf != 10
        change = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            change = np.concatenate([[0], change])
        self.start, self.end = change[0::2], change[1::2]
        begin = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.first = np.searchsorted(self.start, begin)
        self._buf = buf
        self.hash = mix(range_hash(buf, self.start, self.end))
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def prefixes(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word (of the whole word if it is shorter)."""
        return mix(range_hash(self._buf, self.start, np.minimum(self.end, self.start + n)))

    def suffixes(self, n: int) -> np.ndarray:
        """Hash of the last ``n`` bytes of each word (of the whole word if it is shorter)."""
        return mix(range_hash(self._buf, np.maximum(self.start, self.end - n), self.end))

    def text(self, lo: int, hi: int) -> bytes:
        """Words ``lo`` to ``hi - 1`` joined by one space."""
        return b" ".join(self.data[self.start[i]:self.end[i]] for i in range(lo, hi))

    def list(self, lo: int, hi: int) -> list[bytes]:
        if hi <= lo:
            return []
        return self.data[self.start[lo]:self.end[hi - 1]].split(b"\n") if self._single(lo, hi) else [
            self.data[self.start[i]:self.end[i]] for i in range(lo, hi)]

    def _single(self, lo: int, hi: int) -> bool:
        return bool((self.start[lo + 1:hi] == self.end[lo:hi - 1] + 1).all())

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each position on (positions near the end of the data are 0)."""
        out = np.zeros(len(self), np.uint64)
        last = len(self) - n + 1
        if last > 0:
            h = np.zeros(last, np.uint64)
            for j in range(n):
                h = h * np.uint64(_BASE) + self.hash[j:j + last]
            out[:last] = mix(h)
        return out

    def whole(self, n: int) -> np.ndarray:
        """True where the n words from a position on belong to one text."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self))
        return left >= n
