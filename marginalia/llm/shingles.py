"""Hashed word shingles of texts, whole Arrow batches at a time.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's hash is a polynomial over its bytes
modulo 2**64 with an odd base, then mixed; a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Letters folded, white space 0, every other byte above 0.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE[_SPACES] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words before it (one more entry than texts)."""
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    starts_of_texts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    space = _SPACES[joined]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    before = np.searchsorted(starts, starts_of_texts)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    body = joined[starts[0] :]
    lengths = np.diff(np.append(starts, len(joined)))
    within = np.arange(len(body)) - np.repeat(starts - starts[0], lengths)
    sums = np.add.reduceat(_VALUE[body] * _powers(int(lengths.max()))[within], starts - starts[0])
    return mix(sums), before


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: `size` words, or all words of a shorter text, or none."""
    words, before = word_hashes(texts)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64))
    n = len(words)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        full += words[k : k + len(full)] * weights[k]
    full = mix(full)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        count = b - a
        if count >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif count:
            out.append(mix((words[a:b] * weights[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
