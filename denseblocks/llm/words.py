"""Words, word hashes and shingle sets of whole texts, with numpy inside tasks."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Odd multipliers, one per place in a shingle; the base of the byte polynomial; a
# random 64-bit value for each byte.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, np.uint64(base))
    x[0] = 1
    return np.multiply.accumulate(x)


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as long as the longest text so far."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, 2 * self.n)
            self.up, self.down = _powers(_BASE, self.n), _powers(pow(_BASE, -1, 1 << 64), self.n)
        return self.up, self.down


_POWERS = _Powers()


def words(text: bytes | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased. Null has none."""
    return text.translate(_LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all the texts in one array, and the number of words of each."""
    joined = b"\n".join(t or b"" for t in texts).translate(_LOWER)
    b = np.frombuffer(joined, np.uint8)
    word = np.empty(len(b) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[b], out=word[1:-1])
    at = np.flatnonzero(word[1:] != word[:-1])
    start, end = at[::2], at[1::2]
    up, down = _POWERS.upto(len(b) + 1)
    run = np.empty(len(b) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[b] * up[: len(b)], out=run[1:])
    h = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    stops = np.cumsum([len(t or b"") + 1 for t in texts])
    return h, np.diff(np.searchsorted(start, stops), prepend=0)


def _chunks(texts: list[bytes | None], size: int = 1 << 19):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or b"")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text, a 64-bit hash of each of its words: a polynomial over the bytes
    of the word, from running sums over many texts at once."""
    out = []
    for part in _chunks(texts):
        h, n = _runs(part)
        out += np.split(h, np.cumsum(n)[:-1])
    return out


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its 5-word shingles. A text
    of fewer words has its whole sequence as one shingle; one without words has none."""
    out = []
    for part in _chunks(texts):
        h, n = _runs(part)
        m = len(h) - SHINGLE + 1
        x = np.full(max(m, 0), np.uint64(SHINGLE))
        for i in range(SHINGLE if m > 0 else 0):
            x += h[i : m + i] * _PLACE[i]
        x = mix(x)
        at = 0
        for k in n:
            if k >= SHINGLE:
                s = np.sort(x[at : at + k - SHINGLE + 1])
                if (s[1:] == s[:-1]).any():
                    s = s[np.append(True, s[1:] != s[:-1])]
            elif k:
                s = mix(np.full(1, np.uint64(k)) + (h[at : at + k] * _PLACE[:k]).sum(dtype=np.uint64))
            else:
                s = np.empty(0, np.uint64)
            out.append(s)
            at += k
    return out
