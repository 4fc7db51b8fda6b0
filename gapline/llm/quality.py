"""A quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Cuts, col, partitions, texts, without_ids

WORD_END = re.compile(rb"[#$%&*!|<>{}\[\]=+~^_\\](?=[\x20\x09-\x0D]|$)")
BINS = 4096  #: of raw scores, for calibration
TREE = 8  #: vectors that are added up in one task
FOLDS = 2


def statistics(t: bytes) -> list[float]:
    """Statistics of a whole text; all zero-safe, so an empty text has them too."""
    n = len(t)
    raw = np.bincount(np.frombuffer(t, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    w = t.split()
    m = len(w)
    size = np.fromiter(map(len, w), np.int64, m)
    different = len(set(w))
    lines = [x for x in t.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, w[1:], w[:-1]))
    p = raw[raw > 0] / max(n, 1)
    upper, lower, digit = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
    letters = upper + lower + (raw[128:192].sum())
    bar = raw[124]
    symbols = sum(raw[c] for c in b"#$%&*!|<>{}[]=+~^_\\")
    f = lambda x, y: float(x) / max(float(y), 1.0)
    return [
        np.log1p(n), np.log1p(m), f(size.sum(), m), float(size.std()) if m else 0.0, float(size.max()) if m else 0.0,
        f(different, m), f(different, np.sqrt(m)), f(same, m), f(upper, n), f(upper, letters), f(digit, n), f(symbols, n), f(symbols, m),
        f(bar, m), f(len(WORD_END.findall(t)), m), f(raw[33], m), f(raw[46], m), f(raw[44], m), f(raw[10], m), f(raw[32], n), f(raw[128:].sum(), n),
        float(-(p * np.log2(p)).sum()) if n else 0.0, f(len(set(lines)), len(lines)), f(m, len(lines)), np.log1p(len(lines)), f(sum(x[:1].isupper() for x in w), m),
    ]


N_STATS = len(statistics(b""))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts(b.column(1))], np.float64).reshape(-1, N_STATS)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), values], ["id", "stats"])

    return docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / 8, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.fourier(x[k : k + 4096]) @ self.beta for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.xs, self.ys)


def stack(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def sums(df: DataFrame, size: int, f) -> np.ndarray:
    """The sum of f(batch), size numbers, over df, which dealt() has laid out: a vector for each group, then TREE of them at a time, always in the same order."""

    def vector(g: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "v"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size)
        for b in batches:
            g = b.column(b.schema.get_field_index("g")).to_numpy()
            at = np.r_[0, np.flatnonzero(np.diff(g)) + 1, len(g)] if len(g) else np.zeros(1, int)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if now is not None and g[x] != now:
                    yield vector(now, total)
                    total = np.zeros(size)
                now = int(g[x])
                total = total + f(b.slice(x, y - x))
        if now is not None:
            yield vector(now, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, to = np.zeros(size), None
        for b in batches:
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to, total = g // TREE, total + np.frombuffer(v)
        if to is not None:
            yield vector(to, total)

    left, got = partitions(df.sparkSession), df.mapInArrow(each, "g int, v binary")
    while left > TREE:
        left = -(-left // TREE)
        got = got.repartitionById(left, F.expr(f"g div {TREE}").cast("int")).sortWithinPartitions("g").mapInArrow(add, "g int, v binary")
    return sum((np.frombuffer(r.v) for r in sorted(got.collect(), key=lambda r: r.g)), np.zeros(size))


def dealt(train: DataFrame) -> DataFrame:
    """train(id, stats, y) with group g, one for each of the session's partitions, and fold k, both by id, in an order that doesn't depend on how it came."""
    n = partitions(train.sparkSession)
    g, k = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")
    return train.withColumns({"g": g, "k": k}).repartitionById(n, F.col("g")).sortWithinPartitions("g", "id", "stats")


def isotonic(weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of y under weight."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, y, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks])


def fit(train: DataFrame, dim: int = 256, gamma: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> Model:
    """A model from train(id, stats, y), y 0 or 1. Without rows or with one label only, the score is that label's share (1 without rows).

    The calibration is fitted to what each fold of the rows scores by the normal equations of the other folds.
    """
    d = N_STATS
    rows = dealt(train)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = stack(b, "stats")
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0), [b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False).sum()]])

    s = sums(rows, 2 * d + 2, moments)
    n, positive = s[0], s[-1]
    mean = s[1 : d + 1] / max(n, 1)
    scale = np.sqrt(np.maximum(s[d + 1 : 2 * d + 1] / max(n, 1) - mean**2, 1e-12))
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(size=(d, dim)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, dim), np.zeros(dim + d + 1), np.zeros(1), np.ones(1) * (positive / n if n else 1.0))
    if not n or positive in (0, n):
        return model
    size = dim + d + 1
    upper = np.triu_indices(size)
    heavy = np.array([0.5 * n / (n - positive), 0.5 * n / positive])  # both labels weigh the same in the fit

    def normal(b: pa.RecordBatch) -> np.ndarray:
        y, k = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "k"))
        z = model.fourier(stack(b, "stats"))
        zw = z * heavy[y][:, None]
        out = []
        for fold in range(FOLDS):
            own = k == fold
            out += [(zw[own].T @ z[own])[upper], zw[own].T @ y[own], [own.sum()]]
        return np.concatenate(out)

    s = sums(rows, FOLDS * (len(upper[0]) + size + 1), normal).reshape(FOLDS, -1)

    def solve(t: np.ndarray) -> np.ndarray:
        a = np.zeros((size, size))
        a[upper] = t[: len(upper[0])]
        return np.linalg.solve(a + np.triu(a, 1).T + ridge * max(t[-1], 1) * np.eye(size), t[len(upper[0]) : -1])

    model.beta = solve(s.sum(0))
    others = [solve(s.sum(0) - s[fold]) for fold in range(FOLDS)]

    def binned(b: pa.RecordBatch) -> np.ndarray:
        y, k = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "k"))
        r = (model.fourier(stack(b, "stats")) * np.array(others)[k]).sum(1)
        at = np.clip(((r + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, v, BINS) for v in (np.ones(len(at)), y, r)])

    c, y, r = sums(rows, 3 * BINS, binned).reshape(3, BINS)
    full = c > 0
    model.xs, model.ys = r[full] / c[full], np.clip(isotonic(c[full], y[full] / c[full]), 0, 1)
    order = np.argsort(model.xs, kind="stable")
    model.xs = model.xs[order]
    return model


def training(feats: DataFrame, labels: DataFrame, label_col: str, label_id: str, fold: bool) -> DataFrame:
    """(id, stats, y) of the labelled rows outside the held-out fold. A doc_id with several labels takes their rounded mean; null labels are left out."""
    lab = labels.select(col(label_id).cast("long").alias("l"), col(label_col).cast("double").alias("q")).where("l is not null and q is not null")
    lab = lab.groupBy("l").agg(F.round(F.avg("q")).cast("int").alias("y")).where("y in (0, 1)")
    rows = feats.join(lab, feats.id == lab.l).select("id", "stats", "y")
    return rows.where(F.crc32(F.col("id").cast("string")) % 5 != 0) if fold else rows


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", threshold: float = 0.3, fold: bool = True, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    The score comes from statistics of the whole text alone. Rows whose crc32 of the id modulo 5 is 0 are held out of
    the fit (fold=False: none are, but held_out is still told). A null id is never held out and never labelled.
    Null and empty texts are scored as the empty text. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "quality")
    feats = cuts.cut(features(docs, id_col, text_col))
    train = cuts.cut(training(feats, labels, label_col, label_id, fold))
    model = spark.sparkContext.broadcast(fit(train, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.score(stack(b, "stats"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = feats.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs less those whose predicted label is 0. Rows with a null id stay; of rows that share an id, all go if one is rejected."""
    cuts = Cuts(docs.sparkSession, "rejected")
    return without_ids(docs, id_col, cuts.cut(classify(docs, labels, id_col, **how).where("predicted = 0").select("doc_id")))
