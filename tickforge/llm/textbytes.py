"""Words of whole texts in numpy: helpers that run inside tasks.

Texts are handled as UTF-8.  Runs of documents are worked on together, and a long text in
segments of about a megabyte that overlap by window - 1 words, so memory doesn't follow the
longest text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

SEGMENT = 1 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """Cut at white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        m = _BREAK.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def word_groups(texts: list[bytes], split: Callable[[bytes], list[bytes]], overlap: int, limit: int = SEGMENT) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, runs): words of several documents in a row; a run is (document, index of its first word, number of words, of these carried over)."""
    words: list[bytes] = []
    runs: list[tuple[int, int, int, int]] = []
    held = 0
    for doc, text in enumerate(texts):
        at, carry = 0, []
        for part in segments(text):
            new = split(part)
            if new:
                runs.append((doc, at - len(carry), len(carry) + len(new), len(carry)))
                words += carry
                words += new
                at += len(new)
                carry = (carry + new)[-overlap:] if overlap else []
            held += len(part)
            if held >= limit and runs:
                yield words, np.array(runs, dtype=np.int64)
                words, runs, held = [], [], 0
    if runs:
        yield words, np.array(runs, dtype=np.int64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * SEGMENT)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, inverse)]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes by prefix sums."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    up, down = _power(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _ODD
        out += h[j : j + n]
    return mixed(out)


def fits(runs: np.ndarray, k: int) -> np.ndarray:
    """For each start of a k-word window over the joined runs: whether it stays in its run."""
    end = np.repeat(np.cumsum(runs[:, 2]), runs[:, 2])
    return np.arange(len(end)) + k <= end
