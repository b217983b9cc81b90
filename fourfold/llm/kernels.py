"""Vectorised hashing of bytes, words and shingles; a document at a time."""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; longer texts go piece by piece.
PIECE = 1 << 22
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse modulo 2 ** 64, for k up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << max(16, n.bit_length())
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose differences, times the inverse power, are hashes of byte ranges."""
    up, down = powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return sums, down


def _pieces(raw: bytes, size: int):
    """The text in pieces that end at white space."""
    at = 0
    while len(raw) - at > size:
        cut = max(raw.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # a word longer than a piece
            cut = min([k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := raw.find(c, at + size)) >= 0], default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


#: Words longer than this are hashed by BLAKE2.
LONG_WORD = 32


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words between white space, in order.

    Words of up to ``LONG_WORD`` bytes pass eight bytes at a time through a chain
    of nonlinear mixes, which keeps words of up to eight bytes apart for certain.
    No sum of powers is used: its value modulo 2 ** 64 agrees for some pairs of
    long words whatever the base.
    """
    found = []
    for piece in _pieces(raw, PIECE):
        if not piece:
            continue
        padded = np.frombuffer(piece + bytes(8), np.uint8)
        b = padded[: len(piece)]
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~_SPACE[b]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        at = np.ndarray((len(b),), "<u8", padded, 0, (1,))
        size = ends - starts
        h = mix(size.astype(np.uint64) + np.uint64(BASE))
        active = np.flatnonzero(size <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            active = active[size[active] > k]
            if not len(active):
                break
            part = at[starts[active] + k] & _MASKS[np.minimum(size[active] - k, 8)]
            h[active] = mix((h[active] ^ part) * np.uint64(BASE) + np.uint64(k))
        for k in np.flatnonzero(size > LONG_WORD):
            h[k] = int.from_bytes(hashlib.blake2b(piece[starts[k] : ends[k]], digest_size=8).digest(), "little")
        found.append(h)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole sequence where it is shorter; empty without words."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = min(size, len(w))
    up, _ = powers(size)
    total = np.full(len(w) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        total += mix(w[k : len(w) - n + 1 + k] + np.uint64(k)) * up[k + 1]
    return np.unique(mix(total))


def digest(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes()).digest()


def superminhash(elements: np.ndarray, size: int, rows: int = 2048) -> np.ndarray:
    """SuperMinHash signature of a set of 64-bit hashes.

    Every element draws a random permutation of the positions, one swap a step,
    and offers step + uniform at the position it draws. Values of step j are at
    least j, so the steps end once every position holds less than the next step.
    """
    sign = np.full(size, np.inf)
    at = np.arange(size, dtype=np.int32)
    for first in range(0, len(elements), rows):
        own = elements[first : first + rows]
        place = np.tile(at, (len(own), 1))
        line = np.arange(len(own))
        for step in range(size):
            if sign.max() <= step:
                break
            draw = mix(own + np.uint64((step + 1) * BASE % (1 << 64)))
            other = step + (draw & np.uint64(0xFFFFF)).astype(np.int64) % (size - step)
            taken = place[line, other]
            place[line, other] = place[:, step]
            np.minimum.at(sign, taken, step + (draw >> np.uint64(20)).astype(np.float64) * 2.0**-44)
    return sign


def sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values."""
    got, size = values, 1
    while size * 2 <= width:
        got = least(got[:-size], got[size:])
        size *= 2
    if size < width:
        got = least(got[: len(got) - (width - size)], got[width - size :])
    return got
