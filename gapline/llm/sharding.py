"""Histogram sort: exact counts below candidate key boundaries, refined until splitters meet tolerance, then one exchange.

Keys are pairs of signed longs, in order. Every round each partition counts the bytes and rows between the candidate
boundaries and reports a row per interval that isn't empty, with the least and greatest key in it; sums of those are all
the driver sees. A key that many rows share narrows an interval to one point at once, so hot keys end the search early.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Cuts, col, partitions, without

Key = tuple[int, int]
LOW, HIGH = -(1 << 63), (1 << 63) - 1
PROBES = 1 << 16  #: keys that a round asks for, over which splitters make do with fewer each


def join_key(k: Key) -> int:
    return ((k[0] - LOW) << 64) | (k[1] - LOW)


def split_key(n: int) -> Key:
    return (n >> 64) + LOW, (n & ((1 << 64) - 1)) + LOW


class Boundaries:
    """Sorted distinct keys; index() tells how many of them are at or below each key."""

    def __init__(self, keys: list[Key]):
        self.a = np.array([k[0] for k in keys], np.int64)
        self.b = np.array([k[1] for k in keys], np.int64)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.a, a, "left"), np.searchsorted(self.a, a, "right")
        out = hi.copy()
        for k in np.unique(a[lo < hi]):
            own = a == k
            x, y = np.searchsorted(self.a, k, "left"), np.searchsorted(self.a, k, "right")
            out[own] = x + np.searchsorted(self.b[x:y], b[own], "right")
        return out


def histogram(keys: DataFrame, bounds: list[Key]) -> dict[int, tuple]:
    """Of keys(a, b, size): interval -> (bytes, rows, least key, greatest key), for intervals that have rows."""
    at = Boundaries(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            a, b, s = (x.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.lexsort((b, a))
            a, b, s = a[order], b[order], s[order]
            i = at.index(a, b)
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            last = np.r_[first[1:], len(i)] - 1
            cols = [i[first], np.add.reduceat(s, first), last - first + 1, a[first], b[first], a[last], b[last]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["i", "s", "n", "a0", "b0", "a1", "b1"])

    got = keys.mapInArrow(run, "i long, s long, n long, a0 long, b0 long, a1 long, b1 long").groupBy("i")
    got = got.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min(F.struct("a0", "b0")).alias("x"), F.max(F.struct("a1", "b1")).alias("y"))
    return {r.i: (r.s, r.n, tuple(r.x), tuple(r.y)) for r in got.collect()}


@dataclass
class Splits:
    bounds: list[Key]  #: of the fine partitions, less the first's
    shard: list[int]  #: of each fine partition
    first_slot: list[int]  #: of each fine partition, in its shard


def split(keys: DataFrame, shards: int, fine: int, tolerance: float = 0.005, probes: int = 12, rounds: int = 40, whole: bool = True) -> Splits:
    """Splitters that cut keys(a, b, size) into shards of near equal bytes, each of about fine / shards partitions.

    tolerance is of a shard's mean bytes for the shards' splitters, and of a partition's for the others. whole: rows with the same a stay in one
    shard, so a shard misses its share by at most half such a group. Bounds are exact functions of the rows, however
    they are laid out. The driver holds a few numbers for each partition and each of about PROBES probes.
    """
    per = max(1, -(-fine // shards))
    parts = shards * per
    every = histogram(keys, [])
    if not every:
        return Splits([], [0], [0])
    total, _, least, greatest = every[0]
    below: dict[int, int] = {join_key(least): 0, join_key(greatest) + 1: total}  # exact bytes below keys
    wanted = {j: total * j / parts for j in range(1, parts)}
    slack = {j: (tolerance * total / shards if j % per == 0 else 0.1 * total / parts) for j in wanted}
    spans: dict[int, tuple[int, int]] = {}  # least and greatest key from each boundary to the next

    def around(j: int, order: list[int]) -> tuple[int, int]:
        i = bisect_left(order, wanted[j], key=below.__getitem__)
        return order[max(0, i - 1)], order[min(i, len(order) - 1)]

    for _ in range(rounds):
        order = sorted(below)
        new: set[int] = set()
        open_ = [j for j in wanted if min(abs(below[x] - wanted[j]) for x in around(j, order)) > slack[j]]
        each = max(2, min(probes, PROBES // (2 * len(open_) + 1)))
        for j in open_:
            lo, hi = around(j, order)
            x, y = spans.get(lo, (lo, hi - 1))
            x = max(x, lo)
            if x > lo or y + 1 < hi:
                below[x], below[y + 1] = below[lo], below[hi]
            if y > x:
                share = (wanted[j] - below[lo]) / max(1, below[hi] - below[lo])
                at = [share + (k - each / 2) / each**2 for k in range(each + 1)] + [k / each for k in range(1, each)]
                new |= {x + 1 + int((y - x) * min(max(p, 0), 1) * (1 - 1e-12)) for p in at}
        new -= below.keys()
        if not new:
            break
        bounds = sorted(new | below.keys())
        counted = histogram(keys, [split_key(b) for b in bounds if b >> 64 < 1 << 64])
        seen = 0
        for i in range(len(bounds) + 1):
            if i:
                below[bounds[i - 1]] = seen
            if i in counted:
                s, _, x, y = counted[i]
                seen += s
                if i:
                    spans[bounds[i - 1]] = (join_key(x), join_key(y))
    order = sorted(below)
    chosen: dict[int, int] = {}
    for j in wanted:
        lo, hi = around(j, order)
        chosen[j] = lo if wanted[j] - below[lo] <= below[hi] - wanted[j] else hi
    if whole:
        edges = {}
        for j in range(per, parts, per):
            a = (chosen[j] >> 64) << 64
            edges[j] = (a, min(a + (1 << 64), (1 << 128) - 1))
        ends = sorted({x for e in edges.values() for x in e})
        counted = histogram(keys, [split_key(b) for b in ends])
        at, seen = {}, 0
        for i in range(len(ends) + 1):
            if i:
                at[ends[i - 1]] = seen
            seen += counted[i][0] if i in counted else 0
        for j, (x, y) in edges.items():
            chosen[j] = min((x, y), key=lambda e: (abs(at[e] - wanted[j]), e))
    cuts = [chosen[j] for j in sorted(chosen) if j % per == 0]
    inner = sorted({chosen[j] for j in chosen if j % per} | set(cuts))
    bounds = [split_key(min(b, (1 << 128) - 1)) for b in inner]
    shard = [0] + [sum(c <= b for c in cuts) for b in inner]
    counted = histogram(keys, bounds)
    slots, used = [], [0] * shards
    for i, k in enumerate(shard):
        slots.append(used[k])
        used[k] += counted[i][1] if i in counted else 0
    return Splits(bounds, shard, slots)


def exchange(df: DataFrame, splits: Splits, a: Column, b: Column, order: list[Column], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df moved once, into the fine partitions in order of (a, b) and order, with each row's shard and slot."""
    at = Boundaries(splits.bounds)

    @F.pandas_udf("long")
    def place(x, y):
        import pandas as pd

        return pd.Series(at.index(x.to_numpy(), y.to_numpy()))

    placed = df.withColumns({"__a": a, "__b": b}).withColumn("__part", place("__a", "__b"))
    moved = placed.repartitionById(len(splits.shard), F.col("__part").cast("int"))
    moved = moved.sortWithinPartitions("__part", "__a", "__b", *order)
    here = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    pick = lambda values: F.element_at(F.lit(values), F.col("__part").cast("int") + 1)
    out = moved.withColumn("__here", here).withColumn(shard, pick(splits.shard).cast("int")).withColumn(slot, pick(splits.first_slot).cast("long") + F.col("__here"))
    return out.drop("__a", "__b", "__part", "__here")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all, if None) with size, text_crc32, law, shard, slot and grown_shard.

    Law `bytes`: shards have near equal sums of size, the text's UTF-8 bytes plus 1. Order is by the text's 64-bit
    hash and then doc_id, so equal texts stay together in one shard (a group over a shard's share makes that shard
    larger). Null texts count as empty and go with them; null ids come first in their group. Rows that are wholly
    equal take neighbouring slots. Columns of docs whose names are those of the result are left out. An empty table
    gives an empty result. The number of fine partitions is the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    a, b = F.xxhash64(text), F.coalesce(col(id_col).cast("long"), F.lit(LOW))
    size = F.octet_length(text).cast("long") + 1
    cuts = Cuts(spark, "keys")
    keys = cuts.cut(docs.select(a.alias("a"), b.alias("b"), size.alias("size")))
    splits = split(keys, shards, partitions(spark))
    cuts.drop()
    rows = docs.select(*[col(c) for c in (columns or docs.columns) if c.lower() not in own], size.alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), a.alias("__h"), b.alias("__i"))
    out = exchange(rows, splits, F.col("__h"), F.col("__i"), [F.col("text_crc32"), F.col("size")])
    return out.withColumn("grown_shard", F.lit(None).cast("int")).drop("__h", "__i")
