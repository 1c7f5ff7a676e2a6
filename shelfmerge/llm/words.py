"""Words of a batch of texts, found and hashed by numpy a whole batch at a time.

Texts are looked at as bytes. A word is a run of bytes that a 256-entry table does
not name as space; it never crosses from one text to the next. Its hash is a
polynomial over random byte values, taken from running sums, so that no word is
ever made a Python object.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes looked at together: bounds the working memory of very long texts.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: The ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were ever needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            self.up, self.down = (
                np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]) for b in (self.base, self.inverse)
            )
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, mixed with the length."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


BYTE_POWERS = Powers(BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more: the end); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def piece_bounds(data: np.ndarray, bounds: np.ndarray, space: np.ndarray) -> list[int]:
    """Cuts every PIECE bytes, or where the word or text there ends."""
    cuts = [0]
    while len(data) - cuts[-1] > PIECE:
        to = cuts[-1] + PIECE
        stop = int(bounds[np.searchsorted(bounds, to)])
        while to < stop:
            gap = np.flatnonzero(space[data[to : min(stop, to + 4096)]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(stop, to + 4096)
        cuts.append(to)
    return [*cuts, len(data)] if cuts[-1] < len(data) else cuts


@dataclass
class Words:
    """Words in order: byte places, hashes, and the text each lies in."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def find_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """The words of the texts data[bounds[k]:bounds[k + 1]]."""
    cuts, found = piece_bounds(data, bounds, space), []
    for a, b in zip(cuts, cuts[1:]):
        piece = data[a:b]
        solid = ~space[piece]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b)] - a
        edges = edges[edges < len(piece)]
        first[edges] = solid[edges]
        before = edges[edges > 0] - 1
        last[before] = solid[before]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        found.append((start + a, end + a, run_hashes(VALUES[piece], start, end, BYTE_POWERS)))
    if not found:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), none)
    start, end, h = (np.concatenate(x) for x in zip(*found))
    return Words(start, end, h, np.searchsorted(bounds, start, "right") - 1)
