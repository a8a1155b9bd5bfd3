"""Words, lines and 64-bit hashes of many texts at once, as numpy arrays over their bytes.

A word is a maximal run of bytes other than space and \\t to \\r, which in UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over characters.
"""

from __future__ import annotations

import hashlib

import numpy as np

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)   # splitmix64
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)   # the first k of 8 bytes
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ``a`` followed by ``b``."""
    with np.errstate(over="ignore"):
        return mix(a * _M1 + (b ^ _STEP))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the place of each text's first word among them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[-1] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64))
    if not len(starts):
        return hashes
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    whole = None
    live = np.flatnonzero(lengths > 0)
    long = live[lengths[live] > LONG_WORD]
    if len(long):
        whole = data.tobytes()
        for i in long.tolist():
            digest = hashlib.blake2b(whole[starts[i]:ends[i]], digest_size=8).digest()
            hashes[i] = int.from_bytes(digest, "little")
        live = live[lengths[live] <= LONG_WORD]
    done = 0
    while len(live):
        left = lengths[live] - done
        piece = eights[starts[live] + done] & _KEEP[np.minimum(left, 8)]
        hashes[live] = mix(hashes[live] ^ piece)
        done += 8
        live = live[left > 8]
    return hashes


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive hashes; those that run over a text's end are to be masked."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, power, size = None, 0, hashes, 1
    while done < length:
        if length & size:
            piece = power[done:done + n]
            total = piece if total is None else chain(total, piece)
            done += size
        size *= 2
        if size <= length:
            power = chain(power[:-(size // 2)], power[size // 2:])
    return total if length & (length - 1) == 0 else chain(total, np.full(n, length, np.uint64))


def owner(first: np.ndarray) -> np.ndarray:
    """For every word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_windows(first: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows that begin at each word lie within one text."""
    n = int(first[-1])
    if n < length:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))[:n - length + 1]
    return np.arange(n - length + 1) + length <= ends


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]
