"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of letters, digits and characters beyond ASCII, in lower case;
what separates them does not count. A text of fewer words than a shingle has
one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Characters of text that are hashed together.
CHARS = 1 << 18
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_STEP)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_BASE)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Keeps the power tables between batches."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up = self.down = np.zeros(0, np.uint64)
        self.inverse = pow(_BASE, -1, 1 << 64)

    def _tables(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(self.inverse, n)

    def _occurrences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(t.lower() + "\n").encode() for t in texts]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        inside = _WORD[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        word = mix((total[stop] - total[start]) * self.down[start])
        doc = np.searchsorted(ends, start, "right")
        count = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(count) - count
        h = word.copy()
        left = count[doc] - (np.arange(len(word)) - first[doc])  # words from here to the text's end
        for k in range(1, self.words):
            shifted = np.zeros_like(word)
            shifted[:-k] = word[k:]
            h = h * np.uint64(_STEP) + np.where(left > k, shifted, np.uint64(0))
        whole = (left >= self.words) | (np.arange(len(word)) == first[doc]) & (count[doc] < self.words)
        return mix(h[whole]), doc[whole]

    def occurrences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every shingle occurrence, in order of the texts; worked
        out for stretches of texts whose arrays fit the cache."""
        found, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHARS):
                size += len(texts[to])
                to += 1
            h, doc = self._occurrences(texts[at:to])
            found.append((h, doc + at))
            at = to
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, times) of each text's distinct shingles, in order of the texts."""
        h, doc = self.occurrences(texts)
        if not len(h):
            return h, doc, doc
        key = mix(h + doc.astype(np.uint64) * np.uint64(_BASE))
        order = np.argsort(key)
        new = np.diff(key[order], prepend=~key[order[0]]) != 0
        at = np.flatnonzero(new)
        chosen = order[at]
        times = np.diff(at, append=len(key))
        back = np.argsort(chosen)
        return h[chosen][back], doc[chosen][back], times[back]
