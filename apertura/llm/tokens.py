"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that are worked on at a time: bounds the temporary arrays.
PIECE = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Whatever is neither an ASCII letter or digit nor part of a longer UTF-8 character.
_OTHER = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[_FOLD] * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.cumprod(np.full(64, _BASE, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE, dtype=np.uint64))
    return _POWERS


@dataclass
class Words:
    """hashes of all words in order; word k belongs to text ``text[k]``; text i has ``starts[i]:starts[i + 1]``.

    ``first[k]`` is the place of its first byte in all texts, one after the other with a byte between them.
    """

    hashes: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    first: np.ndarray


def words(texts: list[bytes | None], *, letters: bool = False) -> Words:
    """Runs of bytes other than ASCII white space or, with ``letters``, of letters and digits; A-Z count as a-z."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    apart = _OTHER if letters else _SPACE
    hashes, firsts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf) and not (gaps := np.flatnonzero(apart[buf[at:end]])).size:
            end = min(len(buf), end + PIECE)
        if end < len(buf):
            end = at + int(gaps[-1]) + 1
        piece = buf[at:end]
        inside = ~apart[piece]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            lens = last - first
            offset = np.cumsum(lens) - lens
            body = piece[inside]
            place = np.arange(len(body)) - np.repeat(offset, lens)
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(_BYTE[body] * powers(int(lens.max()))[place], offset)
                hashes.append(mix(sums + lens.astype(np.uint64)))
            firsts.append(first + at)
        at = end
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64))
    where = np.concatenate(firsts)
    starts = np.concatenate([[0], np.searchsorted(where, ends_of)])
    return Words(np.concatenate(hashes), np.repeat(np.arange(len(texts)), np.diff(starts)), starts, where)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and the place of each run's first word."""
    count = len(w.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.flatnonzero(w.text[:count] == w.text[n - 1 :])
    with np.errstate(over="ignore"):
        out = w.hashes[place]
        for j in range(1, n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + w.hashes[place + j]
    return mix(out), place
