"""Error-bounded line segments of sorted keys, in whole numbers.

Key y at position x leaves a line between lo = y - epsilon and hi = y + epsilon. Two keys j < i bound its slope from above
by (hi_i - lo_j) / (i - j) and from below by (lo_i - hi_j) / (i - j). By Helly's theorem a run of keys has a line just
when no lower bound of its pairs is above an upper one, and then the least upper bound is the steepest line's slope.

Each segment is the longest run from its start. Runs of up to NEAR keys are found for all starts at once, a distance
between keys after the other, over all lists of a batch laid end to end. A longer run is continued by
blocks, then by doubling and bisection; its least bound comes from Dinkelbach's iteration, a running maximum over the run
in each step.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.operators.stats import PAGE, with_page
from gapline.operators.streams import groups

CHUNK = 1 << 20  #: keys that one unit of work fits; segments don't cross it
TOP = (1 << 31) - 1
NEAR = 32  #: keys of a run that is looked for from all starts at once
BLOCK = 96  #: keys that a longer run is looked for by at a time, up to MIDDLE keys
MIDDLE = 512
AT_ONCE = 1 << 17  #: keys laid end to end at a time, or one unit
SEGMENTS = "list_id long, block_id long, epsilon long, first long, covered long, delta_y long, delta_x long, y_b long, x_b long, first_value long, last_value long, residuals array<long>"


def short_runs(lo: np.ndarray, hi: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every start: the longest run before end, or NEAR + 1 keys of it; how far on the steepest line's later and earlier key are.

    Of pairs with the same bound the first later key counts, and of its pairs the nearest. Ratios of whole numbers below 2 ** 33 by numbers up to
    2 ** 16 are told apart by doubles, and equal ratios are equal doubles.
    """
    n = len(lo)
    length, later, earlier = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    upper, lower = np.full(n, np.inf), np.full(n, -np.inf)  # of each start's run
    least, most, span = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)  # of pairs that end in a key, so far apart at most
    open_ = np.flatnonzero(np.arange(n) + 1 < end)
    for d in range(1, min(NEAR, n - 1) + 1):
        if not len(open_):
            break
        bound = (hi[d:] - lo[:-d]) / d
        closer = bound < least[d:]
        least[d:][closer], span[d:][closer] = bound[closer], d
        np.maximum(most[d:], (lo[d:] - hi[:-d]) / d, out=most[d:])
        at = open_ + d
        low, high = np.maximum(lower[open_], most[at]), np.minimum(upper[open_], least[at])
        fits = low <= high
        open_, at, low, high = open_[fits], at[fits], low[fits], high[fits]
        turned = high < upper[open_]
        later[open_[turned]], earlier[open_[turned]] = d, d - span[at[turned]]
        lower[open_], upper[open_], length[open_] = low, high, d + 1
        open_ = open_[at + 1 < end[open_]]
    return length, later, earlier


def least_bound(lo: np.ndarray, hi: np.ndarray, j: int, i: int) -> tuple[int, int]:
    """The pair j < i with the least (hi[i] - lo[j]) / (i - j): the first such i, and its nearest j. Begins from any pair."""
    x = np.arange(len(lo))
    while True:
        rise, run = int(hi[i] - lo[j]), i - j
        above, below = run * hi - rise * x, run * lo - rise * x
        before = np.maximum.accumulate(below)[:-1]
        left = above[1:] - before
        k = int(left.argmin())
        if left[k] >= 0:
            i = int(np.flatnonzero(left == 0)[0]) + 1
            return int(np.flatnonzero(below[:i] == before[i - 1])[-1]), i
        i = k + 1
        j = int(below[:i].argmax())


@functools.lru_cache(maxsize=64)
def distances(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of keys j below m and i from n up to m: how far i is after j; what rules out those that aren't after."""
    apart = np.arange(n, m) - np.arange(m)[:, None]
    return np.maximum(apart, 1).astype(float), np.where(apart > 0, 0, np.inf)


class Run:
    """The keys from a start on, of which longer and longer prefixes are looked at; top and bottom: the pairs that bound the last one's slopes."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi, self.top, self.bottom = lo, hi, (0, 1), (0, 1)

    def block(self, n: int) -> int:
        """The longest prefix of up to BLOCK more than n keys that has a line, by the bounds of all pairs that end in those."""
        m = min(n + BLOCK, len(self.lo))
        lo, hi = self.lo[:m], self.hi[:m]
        apart, no = distances(n, m)
        found = []
        for (j, i), low, high in ((self.top, lo, hi), (self.bottom, -hi, -lo)):
            bound = (high[n:] - low[:, None]) / apart + no
            each, old = bound.min(0), (high[i] - low[j]) / (i - j)
            found.append((bound, each, old, np.minimum(np.minimum.accumulate(each), old)))
        far = int(np.r_[found[0][3] + found[1][3] < 0, True].argmax())
        pairs = [self.top, self.bottom]
        for k, (bound, each, old, so_far) in enumerate(found):
            if far and so_far[far - 1] < old:
                i = int(each[:far].argmin())
                pairs[k] = (int(np.flatnonzero(bound[:, i] == each[i])[-1]), n + i)
        self.top, self.bottom = pairs
        return n + far

    def fits(self, n: int) -> tuple[bool, int]:
        """Whether the first n keys have a line; how many of them are enough to tell that they have none."""
        lo, hi = self.lo[:n], self.hi[:n]
        a, b = least_bound(lo, hi, *self.top), least_bound(-hi, -lo, *self.bottom)
        upper, lower = (int(hi[a[1]] - lo[a[0]]), a[1] - a[0]), (int(lo[b[1]] - hi[b[0]]), b[1] - b[0])
        if lower[0] * upper[1] <= upper[0] * lower[1]:
            self.top, self.bottom = a, b
            return True, n
        return False, max(a[1], b[1]) + 1

    def longest(self) -> int:
        """The longest prefix that has a line, of two keys at least."""
        total, known = len(self.lo), 2
        while known < min(MIDDLE, total):
            n = self.block(known)
            if n < min(known + BLOCK, total):
                return n
            known = n
        bad = total + 1
        while known < total and bad > total:
            ok, n = self.fits(min(2 * known, total))
            known, bad = (n, bad) if ok else (known, n)
        while bad - known > 1:
            ok, n = self.fits((known + bad) // 2)
            known, bad = (n, bad) if ok else (known, n)
        return known


def cut(keys: np.ndarray, epsilon: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, covered, delta_y, delta_x, y_b, x_b) of segments of units laid end to end; places count through all of them.

    Unit i ends before ends[i]. A key alone makes a flat segment.
    """
    lo, hi = np.maximum(keys - epsilon, 0), np.minimum(keys + epsilon, TOP)
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    length, later, earlier = short_runs(lo, hi, end)
    size, i, j = length.tolist(), later.tolist(), earlier.tolist()
    out: list[tuple[int, int, int, int]] = []
    at = 0
    for stop in ends.tolist():
        while at < stop:
            n, a, b = size[at], j[at], i[at]
            if n > NEAR and at + n < stop:
                run = Run(lo[at:stop], hi[at:stop])
                n = run.longest()
                a, b = run.top
            out.append((at, n, at + a, at + b))
            at += n
    first, covered, a, b = np.array(out, np.int64).reshape(-1, 4).T
    alone = covered == 1
    rise, base = np.where(alone, 0, hi[b] - lo[a]), np.where(alone, keys[first], lo[a])
    return first, covered, rise, np.where(alone, 1, b - a), base, a


def approximate(pos: np.ndarray, dy: np.ndarray, dx: np.ndarray, yb: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """The line's values at pos, rounded half away from zero."""
    d = pos - xb
    n = dy * d + (dx // 2) * np.sign(d)
    return np.sign(n) * (np.abs(n) // dx) + yb


def fitted(units: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Segments of units (list_id, block_id, epsilon, positions, keys)."""
    sizes = np.array([len(u[3]) for u in units])
    pos, keys = (np.concatenate([u[k] for u in units]) for k in (3, 4))
    ends = np.cumsum(sizes)
    first, covered, dy, dx, yb, xb = cut(keys, np.repeat([u[2] for u in units], sizes), ends)
    shift = pos[first] - first  # of a segment's places, to positions
    each = lambda v: np.repeat(v, covered)
    rest = keys - approximate(np.arange(len(keys)), each(dy), each(dx), each(yb), each(xb))
    who = np.searchsorted(ends, first, "right")
    own = [np.array([u[k] for u in units])[who] for k in range(3)]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(keys)].astype(np.int32)), pa.array(rest))
    cols = [*own, first + shift, covered, dy, dx, yb, xb + shift, keys[first], keys[first + covered - 1]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), lists], [x.split()[0] for x in SEGMENTS.split(", ")])


def fit(keyed: DataFrame, block_table: DataFrame, partitions: int | None = None) -> DataFrame:
    """Segments with their residuals of keyed(list_id, pos, doc_id) cut by block_table.

    Keys meet their block by page, not by list: a list of many blocks isn't compared with all of them, and a hot list is
    many join keys.
    """
    single = block_table.select("list_id", "block_id", "start_idx", "end_idx", "epsilon")
    paged = single.withColumn("page", F.explode(F.expr(f"sequence(start_idx div {PAGE}, (end_idx - 1) div {PAGE})")))
    rows = with_page(keyed).join(paged, ["list_id", "page"]).where("pos >= start_idx and pos < end_idx")
    return _fit(rows, F.expr(f"(pos - start_idx) div {CHUNK}"), partitions)


def fit_lists(keyed: DataFrame, epsilon: int, partitions: int | None = None) -> DataFrame:
    """fit with each list as one block: no table of blocks, and no join, is needed."""
    whole = keyed.withColumns({"block_id": F.lit(0).cast("bigint"), "epsilon": F.lit(epsilon).cast("bigint")})
    return _fit(whole, F.expr(f"pos div {CHUNK}"), partitions)


def _fit(rows: DataFrame, chunk: Column, partitions: int | None) -> DataFrame:
    """A unit is a chunk of CHUNK positions of a block; units are dealt by hash and fitted in one stream per task, so
    many small lists share a Python call and a long list is spread over tasks."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = rows.select("list_id", "block_id", chunk.alias("chunk"), "epsilon", "pos", "doc_id")
    dealt = units.repartition(n, "list_id", "block_id", "chunk").sortWithinPartitions("list_id", "block_id", "chunk", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for (list_id, block_id, _, epsilon), (pos, doc) in groups(batches, 4):
            held.append((list_id, block_id, epsilon, pos, doc))
            size += len(pos)
            if size >= AT_ONCE:
                yield fitted(held)
                held, size = [], 0
        if held:
            yield fitted(held)

    return dealt.mapInArrow(run, SEGMENTS)
