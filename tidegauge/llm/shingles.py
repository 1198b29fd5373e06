"""Word shingles of whole texts as 64-bit hashes, in flat numpy arrays."""

from __future__ import annotations

import numpy as np

BLOCK = 4 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(BASE, -1, 2**64)
#: Bytes of a word: ASCII letters and digits, and all bytes of other characters.
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << (n - 1).bit_length()
        held = np.full(size, base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the place of its last byte.  Blocks end outside words, so memory follows the number of words."""
    code = np.frombuffer(raw, np.uint8)
    inside = WORD[code]
    hashes, ends = [], []
    at = 0
    while at < len(code):
        end = min(len(code), at + BLOCK)
        while end < len(code) and inside[end]:  # a word goes on
            end += 1
        own, part = inside[at:end], code[at:end]
        edge = np.diff(own.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(part)), out=total[1:])
            hashes.append(mix((total[last] - total[first]) * _power(_UNDO, len(part))[first] + (last - first).astype(np.uint64)))
            ends.append(last + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(ends)


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of some texts, one text after the other, and how many each has.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    raw = [t.encode() for t in texts]
    hashes, ends = words(b"\n".join(raw))
    bounds = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raw]))])
    count = np.diff(bounds)
    n = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    if not len(hashes):
        return hashes, n
    starts = np.repeat(bounds[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(bounds[1:], n) - starts
    hashes = np.concatenate([hashes, np.zeros(size, np.uint64)])
    out = np.zeros(len(starts), np.uint64)
    for j in range(size):
        out = out * np.uint64(BASE) + np.where(left > j, hashes[starts + j], np.uint64(0))
    return mix(out), n


def weighed(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of their hash, how often each stands in it, and how many each text has."""
    every, n = shingles(texts, size)
    values, times, count, at = [], [], [], 0
    for k in n.tolist():
        own = np.sort(every[at : at + k])
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if k else np.zeros(0, np.int64)
        values.append(own[new])
        times.append(np.diff(new, append=k))
        count.append(len(new))
        at += k
    return np.concatenate([*values, np.zeros(0, np.uint64)]), np.concatenate([*times, np.zeros(0, np.int64)]), np.array(count, np.int64)
