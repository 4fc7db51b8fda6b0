"""Exact top-k by norm-bucketed retrieval.

The longest vectors of all give each query a score that its k-th best reaches. Each task puts its vectors into buckets
of like length, longest first, a batch at a time. For a query whose least score is known, a bucket's longest vector tells which cosine a vector of that bucket needs: over 1, the bucket and all after it are
pruned by length; high, coordinates prune (a vector whose cosine is high must lie near the query in each coordinate);
low, only the bucket's prefix of long enough vectors is looked at, for many queries at once. What is left is verified by
exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.common import Cuts, col

COORDINATE = 0.9  #: from this local cosine on, coordinates prune
FOCUS = 3  #: coordinates looked at
BUCKET = 4096  #: vectors of a bucket at most
LONGEST = 1024  #: vectors that all queries meet first
TOGETHER = 256  #: queries multiplied with a bucket at once
RATIO = 1.05  #: longest to shortest of a bucket at most
SAFE = 1e-9
ROUNDED = 1e-6  #: of a coordinate; near a cosine of 1 an error of the local cosine counts as its square root


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null id, vector or component, or one not finite, are left out."""
    x = col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), F.when(fine, x).alias("x")).where("vec_id is not null and x is not null")
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).cast("array<double>").alias("v"))


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of q and p (whole numbers as doubles), kept within the range of a long."""
    most = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ p.T).astype(np.int64)
    big = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in p]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(sum(map(int.__mul__, x, y)), low), high) for y in big[1]] for x in big[0]], np.int64).reshape(len(q), len(p))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


class Queries:
    """Queries of one dimension: least is a score that the k-th best reaches at least, where `known`; found is the best so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, least: list[int | None], k: int):
        self.ids, self.v, self.k = ids, v, k
        self.norm = np.sqrt((v * v).sum(1))
        self.known = np.array([x is not None for x in least], bool)
        self.least = np.array([x or 0 for x in least], np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges candidates of query n, those below its least score left out."""
        if self.known[n]:
            near = scores >= self.least[n]
            scores, ids = scores[near], ids[near]
        if len(scores):
            s, i = np.concatenate([self.found[n][0], scores]), np.concatenate([self.found[n][1], ids])
            pick = best(s, i, self.k)
            self.found[n] = s[pick], i[pick]
            if len(pick) == self.k:
                self.least[n], self.known[n] = max(self.least[n], s[pick[-1]]) if self.known[n] else s[pick[-1]], True


class Buckets:
    """Vectors of one dimension, by length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        length = np.sqrt((v * v).sum(1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        self.ends: list[tuple[int, int]] = []
        at = 0
        while at < len(order):
            low = self.length[at] / RATIO
            end = min(at + BUCKET, int(np.searchsorted(-self.length, -low, "right")))
            self.ends.append((at, max(end, at + 1)))
            at = self.ends[-1][1]

    def search(self, q: Queries) -> None:
        """Merges each query's best into q, bucket after bucket; the local cosine of each query tells how it prunes there."""
        for lo, hi in self.ends:
            reach = q.norm * self.length[lo]
            open_ = ~(q.known & (reach * (1 + SAFE) < q.least))  # else no vector from here on is long enough
            local = np.where(q.known & (reach > 0), q.least / np.where(reach > 0, reach, 1.0) * (1 - 1e-12), -1.0)
            for n in np.flatnonzero(open_ & (local >= COORDINATE)):
                take = self.alike(q.v[n] / q.norm[n], float(local[n]), lo, hi)
                take = take[self.ids[take] != q.ids[n]]
                if len(take):
                    q.add(n, products(q.v[n : n + 1], self.v[take])[0], self.ids[take])
            rest = np.flatnonzero(open_ & (local < COORDINATE))
            for k in range(0, len(rest), TOGETHER):
                some = rest[k : k + TOGETHER]
                short = np.where(q.known[some] & (q.least[some] > 0) & (q.norm[some] > 0), q.least[some] / np.maximum(q.norm[some], 1e-300) * (1 - SAFE), -1.0)
                end = lo + int(np.searchsorted(-self.length[lo:hi], -short.min(), "right"))
                s = products(q.v[some], self.v[lo:end])
                near = (s >= np.where(q.known[some], q.least[some], np.iinfo(np.int64).min)[:, None]) & (self.ids[lo:end] != q.ids[some][:, None])
                for m in np.flatnonzero(near.any(1)):
                    q.add(int(some[m]), s[m, near[m]], self.ids[lo:end][near[m]])

    def alike(self, unit: np.ndarray, local: float, lo: int, hi: int) -> np.ndarray:
        """Those of lo to hi that may be within the angle arccos(local) of unit, by a few coordinates."""
        take = np.arange(lo, hi)
        slack = math.sqrt(max(0.0, 1 - local * local))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            c = self.v[take, f] / np.maximum(self.length[take], 1e-300)
            wide = slack * math.sqrt(max(0.0, 1 - unit[f] ** 2)) + ROUNDED
            # within that angle a coordinate may come to its pole, -1 or 1
            low = -1.0 if unit[f] <= -local else unit[f] * local - wide
            high = 1.0 if unit[f] >= local else unit[f] * local + wide
            take = take[(c >= low - ROUNDED) & (c <= high + ROUNDED)]
        return take


def by_dimension(ids: np.ndarray, v: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, matrix) of the vectors of each dimension."""
    start, size = v.offsets.to_numpy()[:-1].astype(np.int64), np.diff(v.offsets.to_numpy())
    flat = v.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        yield own, ids[own], flat[start[own][:, None] + np.arange(d)]


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, every: int = 100, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by every; candidates are all rows but those with the query's own id
    and those of another dimension; scores stay within a long. Vectors that are null or hold a null or non-finite component take no part. Rows
    repeated as a whole count once each as candidates and once together as a query; of several vectors with one query
    id, the smallest is the query. What the longest vectors score tells every query its least score first. Then queries
    go out in blocks of about block_bytes, each a pass over all candidates; the driver holds one block at a time.
    """
    if k < 1:
        raise ValueError("k: 1 or more")
    spark = vectors.sparkSession
    cuts = Cuts(spark, "topk")
    all_ = cuts.cut(quantised(vectors, id_col, vector_col, scale))
    asked = all_.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = all_.orderBy(length.desc(), "vec_id", "v").limit(LONGEST).toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast((longest.column(0).to_numpy(), longest.column(1).combine_chunks()))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {v.shape[1]: Buckets(i, v) for _, i, v in by_dimension(*sent.value)}
        for b in batches:
            out: list[int | None] = [None] * b.num_rows
            for own, ids, v in by_dimension(b.column(0).to_numpy(), b.column(1)):
                if v.shape[1] in known:
                    q = Queries(ids, v, [None] * len(ids), k)
                    known[v.shape[1]].search(q)
                    for n, (scores, _) in zip(own, q.found, strict=True):
                        out[n] = int(scores[-1]) if len(scores) == k else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["vec_id", "v", "least"])

    asked = cuts.cut(asked.mapInArrow(least, "vec_id long, v array<double>, least long"))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0) // block_bytes))
    path = f"{cuts.base}/found"
    schema = "query_id long, vec_id long, score long"
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow().combine_chunks()
        mine = spark.sparkContext.broadcast(tuple(c.combine_chunks() for c in block.columns))

        def run(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            ids, v, least = mine.value
            least = least.to_pylist()
            asked = {m.shape[1]: Queries(i, m, [least[n] for n in own], k) for own, i, m in by_dimension(ids.to_numpy(), v)}
            for b in batches:
                for _, i, m in by_dimension(b.column(0).to_numpy(), b.column(1)):
                    if m.shape[1] in asked:
                        Buckets(i, m).search(asked[m.shape[1]])
            for q in asked.values():
                some = [(i, s, f) for i, (s, f) in zip(q.ids.tolist(), q.found, strict=True) if len(s)]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in some], [len(x[1]) for x in some])), pa.array(np.concatenate([x[2] for x in some])), pa.array(np.concatenate([x[1] for x in some]))], ["query_id", "vec_id", "score"])

        all_.mapInArrow(run, schema).write.mode("append").parquet(path)
        mine.unpersist()
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(path)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
