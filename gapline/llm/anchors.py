"""Content-defined anchors of long windows, over any symbols (words, bytes).

A window of `window` symbols is anchored at the least hash among its `gram`-symbol grams (leftmost of ties), so equal
windows have equal anchors at equal offsets wherever they stand, and about two positions in window - gram are anchors.
Very common grams (the hot set) are passed over where a window has another one: what stands beside a common line is
then anchored in its own text, and no anchor gathers a large share of all contexts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gapline.llm.common import mix

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ALL = np.uint64((1 << 64) - 1)


class Powers:
    """BASE ** i and BASE ** -i modulo 2 ** 64, as far as they have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Hashes:
    """Hashes of ranges of one sequence of 64-bit symbol hashes."""

    def __init__(self, symbols: np.ndarray):
        self.up, down = POWERS.get(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * down[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])

    def every(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.up[: len(self.sums) - size])


def least(values: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w consecutive values is, the leftmost of ties."""
    at, span = np.arange(len(values), dtype=np.int32), 1

    def meet(values: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        right = values[by:] < values[:-by]
        return np.where(right, values[by:], values[:-by]), np.where(right, at[by:], at[:-by])

    while 2 * span <= w:
        values, at = meet(values, at, span)
        span *= 2
    return meet(values, at, w - span)[1] if span < w else at


@dataclass
class Runs:
    """Runs of windows with the same anchor: window starts, how many, the anchor's place and key, whether passed to it from a hot one."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    moved: np.ndarray
    doc: np.ndarray


def runs(symbols: np.ndarray, ends: np.ndarray, window: int, gram: int, hot: np.ndarray | None = None) -> tuple[Runs, Hashes]:
    """Of documents laid end to end in symbols (document i ends before ends[i]); hot: sorted keys."""
    hashes = Hashes(symbols)
    n = len(symbols) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(bool), none), hashes
    g = hashes.every(gram)
    at = least(g, window - gram + 1)
    doc = np.searchsorted(ends, np.arange(n), "right")
    whole = np.arange(n) + window <= ends[doc]
    moved = np.zeros(n, bool)
    if hot is not None and len(hot):
        common = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
        if (whole & common[at]).any():
            other = np.where(common, ALL, g)
            rare = least(other, window - gram + 1)
            moved = common[at] & ~common[rare]
            at = np.where(moved, rare, at)
    new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (moved[1:] != moved[:-1])] & whole
    start = np.flatnonzero(new | (whole & np.r_[True, ~whole[:-1]]))
    stop = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True])
    return Runs(start, stop - start + 1, at[start].astype(np.int64), g[at[start]], moved[start], doc[start]), hashes


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in [start, end) of some pair."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0
