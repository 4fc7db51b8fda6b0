"""Blocks of pages, each with the error bound that suits it: greedy, optimal, or one per list."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions.columns import BASE_BITS, SCALE, C
from gapline.operators.stats import PAGE
from gapline.operators.streams import groups

SPAN = {"greedy": 1 << 16, "optimal": 1 << 10}  #: pages that are partitioned together; a longer list is partitioned span by span
BLOCKS = "list_id long, block_id long, start_idx long, end_idx long, epsilon long, cost double"


class Ranges:
    """Statistics of ranges of consecutive pages, from exact prefix sums; bounds may be arrays."""

    def __init__(self, n: np.ndarray, first: np.ndarray, last: np.ndarray, squares: list[int], scale: int, c: float):
        self.scale, self.c, self.first, self.last = scale, c, first, last
        self.n = np.concatenate([[0], np.cumsum(n)])
        jump = (first[1:] - last[:-1]).astype(object)
        # squares of gaps up to each page's end, those between pages included, and of the gap before each page
        self.before = np.concatenate([[0], jump * jump]).astype(object)
        self.upto = np.concatenate([[0], np.cumsum(np.array(squares, object) + self.before, dtype=object)])

    def __len__(self) -> int:
        return len(self.first)

    def variance(self, a: np.ndarray | int, b: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and gap variance of pages a to b - 1; 0 for fewer than two gaps."""
        n = self.n[b] - self.n[a]
        g = (n - 1).astype(object)
        s = (self.last[b - 1] - self.first[a]).astype(object)
        spread = np.asarray(g * (self.upto[b] - self.upto[a] - self.before[a]) - s * s, float)
        pairs = np.asarray(g * (g - 1), float)
        return n, np.where(pairs > 0, np.maximum(spread, 0) / np.maximum(pairs, 1), 0.0)

    def cost(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        n, v = self.variance(a, b)
        some = (n > 1) & (v > 0) & (self.c > 0)
        return np.where(some, (n - 1) * np.maximum(0.0, BASE_BITS + 0.5 * np.log2(np.where(some, self.c * self.scale * v, 1.0))), 0.0)

    def epsilon(self, a: int, b: int) -> int:
        n, v = self.variance(np.int64(a), np.int64(b))
        if n < 2 or v <= 0:
            return 1
        e = math.ceil(math.sqrt(2 * math.log(2.0) * self.c * self.scale * float(v) * (int(n) - 1) / int(n)))
        return (1 << max(1, e.bit_length())) - 1


def greedy(r: Ranges, m: int) -> list[tuple[int, int]]:
    """Splits the costliest range at its best page border while fewer than m ranges wait; ranges of one page are done."""
    whole = (0, len(r))
    if m > len(r):  # no more than the pages can wait, so every range is split
        return [(k, k + 1) for k in range(len(r))] if r.c > 0 else [whole]
    heap, done = [(0.0, *whole)], []
    while heap and len(heap) < m and r.c > 0:
        _, a, b = heapq.heappop(heap)
        if b - a == 1:
            done.append((a, b))
            continue
        at = np.arange(a + 1, b)
        left, right = r.cost(np.full(len(at), a), at), r.cost(at, np.full(len(at), b))
        k = int((left + right).argmin())
        heapq.heappush(heap, (-left[k], a, int(at[k])))
        heapq.heappush(heap, (-right[k], int(at[k]), b))
    return sorted(done + [(a, b) for _, a, b in heap])


def optimal(r: Ranges, m: int) -> list[tuple[int, int]]:
    """Exactly min(m, pages) ranges of least total cost."""
    n = len(r)
    m = min(m, n)
    cost = np.full((n + 1, n + 1), np.inf)
    a, b = np.triu_indices(n + 1, 1)
    for k in range(0, len(a), 1 << 16):
        cost[a[k : k + (1 << 16)], b[k : k + (1 << 16)]] = r.cost(a[k : k + (1 << 16)], b[k : k + (1 << 16)])
    best, back = cost[0].copy(), []
    for _ in range(m - 1):
        total = best[:, None] + cost
        back.append(total.argmin(0))
        best = total.min(0)
    if not np.isfinite(best[n]):
        return [(0, n)]
    out, end = [], n
    for step in reversed(back):
        out.append((int(step[end]), end))
        end = int(step[end])
    return [(0, end), *reversed(out)]


def merge(r: Ranges, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
    """Neighbours with the same epsilon become one, which keeps it; the cost is that of the whole."""
    out: list[list] = []
    for a, b in ranges:
        e = r.epsilon(a, b)
        if out and out[-1][2] == e:
            out[-1][1] = b
        else:
            out.append([a, b, e])
    costs = r.cost(np.array([x[0] for x in out]), np.array([x[1] for x in out]))
    return [(a, b, e, cost) for (a, b, e), cost in zip(out, costs.tolist(), strict=True)]


def blocks(page_table: DataFrame, m: int = 2048, variant: str = "none", method: str = "greedy", c: float = C) -> DataFrame:
    """(list_id, block_id, start_idx, end_idx, epsilon, cost): blocks tile each list; end_idx is exclusive. Each task partitions a stream of lists."""
    scale, split, span = SCALE[variant], {"greedy": greedy, "optimal": optimal}[method], SPAN[method]
    n = int(page_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = page_table.select("list_id", F.expr(f"page div {span}").alias("span"), "page", "n", "first_id", "last_id", F.col("sum_gap2").cast("string").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (list_id, part), (page, keys, first, last, squares) in groups(batches, 2):
            r = Ranges(keys, first, last, [int(x) for x in squares], scale, c)
            start = int(page[0]) * PAGE
            out += [(list_id, (part << 32) + i, start + int(r.n[a]), start + int(r.n[b]), e, cost) for i, (a, b, e, cost) in enumerate(merge(r, split(r, m)))]
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

    return pages.repartition(n, "list_id", "span").sortWithinPartitions("list_id", "span", "page").mapInArrow(run, BLOCKS)


def single_blocks(page_table: DataFrame, epsilon: int) -> DataFrame:
    """One block per list with a fixed epsilon."""
    out = page_table.groupBy("list_id").agg(F.sum("n").cast("bigint").alias("end_idx"))
    return out.select("list_id", F.lit(0).cast("bigint").alias("block_id"), F.lit(0).cast("bigint").alias("start_idx"), "end_idx", F.lit(epsilon).cast("bigint").alias("epsilon"), F.lit(None).cast("double").alias("cost"))


def epsilon_histogram(block_table: DataFrame) -> DataFrame:
    return block_table.groupBy("epsilon").agg(F.count("*").alias("n_blocks"))


def unparted(block_table: DataFrame) -> DataFrame:
    """(n_unparted): lists of one block."""
    return block_table.groupBy("list_id").count().where("count = 1").agg(F.count("*").alias("n_unparted"))
