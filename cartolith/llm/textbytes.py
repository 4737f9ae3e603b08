"""Vectorised word and shingle hashing over UTF-8 bytes.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; those
separators are ASCII, so splitting bytes equals splitting code points.  All
hashes are 64-bit and depend on the bytes alone: they are equal on every
machine, in every process and in every Python version.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
SEPARATORS = b" \t\n\x0b\x0c\r"


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element, on a uint64 array."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _byte_table(lower: bool) -> np.ndarray:
    table = splitmix(np.arange(256, dtype=_U) + _U(7_001)) | _U(1)
    if lower:
        table[65:91] = table[97:123]
    table[list(SEPARATORS)] = 0
    return table


_BYTES = {lower: _byte_table(lower) for lower in (False, True)}
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and how many words each text has."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = _IS_WORD[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts = edge[0::2] if not (len(word) and word[0]) else np.r_[0, edge[1::2]]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    first = int(starts[0])
    gaps = np.diff(np.r_[starts, len(buf)])
    place = np.arange(first, len(buf)) - np.repeat(starts, gaps)
    weight = splitmix(np.arange(int(gaps.max()), dtype=_U) + _U(90_001)) | _U(1)
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(_BYTES[lower][buf[first:]] * weight[place], starts - first)
    ends = np.cumsum(sizes)
    upto = np.searchsorted(starts, ends)
    return splitmix(hashes), np.diff(np.r_[0, upto])


def shingles(texts: list[bytes], k: int, lower: bool = True) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A text of 1 to k-1 words has one shingle, its whole word sequence; a text
    without words has none.
    """
    words, counts = word_hashes(texts, lower)
    out, at = [], 0
    with np.errstate(over="ignore"):
        scale = splitmix(np.arange(k, dtype=_U) + _U(400_009)) | _U(1)
        n = len(words)
        rows = np.zeros(max(n - k + 1, 0), _U)
        for j in range(k if len(rows) else 0):
            rows += words[j : n - k + 1 + j] * scale[j]
        rows = splitmix(rows)
        for c in counts.tolist():
            if c >= k:
                out.append(np.unique(rows[at : at + c - k + 1]))
            elif c:
                short = (words[at : at + c] * scale[:c]).sum(dtype=_U) + _U(c)
                out.append(splitmix(np.array([short], _U)))
            else:
                out.append(np.zeros(0, _U))
            at += c
    return out


def batches(texts: list[bytes], most: int = 1_000_000):
    """Index ranges of ``texts`` with about ``most`` bytes each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
