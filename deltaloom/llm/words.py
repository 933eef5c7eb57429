"""Words of a text and 64-bit hashes of words and word windows, in numpy.

A word is a maximal run of bytes other than space and the bytes 9 to 13, which is what
``bytes.split()`` gives on UTF-8. A word's hash depends on its bytes alone: a polynomial over
mixed byte values modulo 2**64, taken from prefix sums and shifted back to position 0.
Long texts are hashed in pieces that end between words, so temporary memory does not follow
the length of a text (but for a single word longer than a piece).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=_U)
_inverses = np.ones(1, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of ``x`` over the result."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0xD1B54A32D192ED03))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, PIECE)
        for name, base in (("_powers", _BASE), ("_inverses", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=_U)
    return _powers[:n], _inverses


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], IS_SPACE[b], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def pieces(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at white space or at the end of ``data``."""
    start, n = 0, len(data)
    while start < n:
        stop = start + PIECE
        if stop < n:
            b = np.frombuffer(data, dtype=np.uint8)
            while stop < n:
                gap = np.flatnonzero(IS_SPACE[b[stop : stop + PIECE]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop += PIECE
        stop = min(stop, n)
        yield start, stop
        start = stop


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (uint64), start offsets and end offsets of the words of ``data``."""
    found = [_hash_piece(data, a, z) for a, z in pieces(data)]
    if not found:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hash_piece(data: bytes, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, dtype=np.uint8, count=stop - start, offset=start)
    a, z = spans(b)
    powers, inverses = _tables(len(b))
    total = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum(_BYTE[b] * powers, dtype=_U, out=total[1:])
    h = (total[z] - total[a]) * inverses[a]
    return mix(h + (z - a).astype(_U)), a + start, z + start


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _U(_BASE)
        out += h[j : j + n]
    return mix(out)


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of ``k``-word windows; a text of fewer words gives its whole sequence."""
    h, _, _ = hash_words(data)
    if not len(h):
        return h
    return np.unique(windows(h, min(k, len(h))))


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the ``n`` positions inside windows of length ``k`` that begin where ``starts`` is true."""
    step = np.zeros(n + 1, dtype=np.int32)
    at = np.flatnonzero(starts)
    step[at] += 1
    step[at + k] -= 1
    return np.cumsum(step[:n]) > 0


def repeated(h: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Mask of the entries of ``h`` that occur at least twice; with ``later_only``, without their first occurrence."""
    out = np.zeros(len(h), dtype=bool)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    out[order[same + 1]] = True
    if not later_only:
        out[order[same]] = True
    return out
