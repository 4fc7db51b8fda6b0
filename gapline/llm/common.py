"""What the operators of this folder share: tables in the shared folder, column names, shingles, components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.sources.store import shared_dir


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gapline/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_cut: list[str] = []  #: folders of tables that this process has cut and not deleted


@contextlib.contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that operators have cut within it: what is returned must have been written by then."""
    before = len(_cut)
    try:
        yield
    finally:
        for path in _cut[before:]:
            delete(spark, path)
        del _cut[before:]


class Cuts:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, new_path(spark, name), 0
        _cut.append(self.base)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int | None = None) -> None:
        """Deletes the n-th table, or all."""
        delete(self.spark, self.base if n is None else f"{self.base}/{n}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; none for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names clash, in any case, with names."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def words(text: bytes) -> list[bytes]:
    """ASCII-lower-cased words: runs of bytes other than space and \\x09-\\x0D."""
    return text.lower().split()


def shingles(w: list[bytes], k: int) -> list[bytes]:
    """k-word shingles, repeats included; the whole sequence if it is shorter; none without words."""
    if len(w) <= k:
        return [b" ".join(w)] if w else []
    return [b" ".join(t) for t in zip(*(w[i:] for i in range(k)), strict=False)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(cuts: Cuts, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b) but the roots: root is the component's smallest node.

    Alternating large-star and small-star steps on distributed edges; each round is a written table. Minima are
    combined before the shuffle, so a node with very many edges costs one row per task.
    """
    two = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b")
    two = cuts.cut(two.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = two.union(two.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select(F.col("u"), F.col("m"))).distinct()
        two = cuts.cut(small)
        cuts.drop(cuts.n - 1)
        now = two.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return two.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"no stable components after {rounds} rounds")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, by label propagation with pointer jumping."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(before, label):
            break
    return label


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def bloom_filter(ids: DataFrame, most_bits: int = 26) -> np.ndarray | None:
    """A bit per slot, at most 8 MB, for one column of ids; None where there are too many ids for it to tell much."""
    n = ids.count()
    bits = min(most_bits, max(16, (16 * n).bit_length()))
    if 4 * n > 1 << bits:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << bits, bool)
        for b in batches:
            for x in probes(b.column(0).to_numpy(), bits):
                slots[x] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(slots).tobytes()], pa.binary())], ["v"])

    parts = [np.frombuffer(r.v, np.uint8) for r in ids.repartition(4).mapInArrow(run, "v binary").collect()]
    return np.bitwise_or.reduce(parts) if parts else np.zeros((1 << bits) // 8, np.uint8)


def probes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [(h >> np.uint64(s)) & np.uint64((1 << bits) - 1) for s in (0, 32)]


def in_filter(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for x in probes(ids, (8 * len(packed)).bit_length() - 1):
        out &= (packed[x >> np.uint64(3)] >> (np.uint64(7) - (x & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return out


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """df less the rows whose id is among ids (one column); rows with a null id stay.

    Rows that a bounded filter of ids rules out pass as they are; only the others meet ids in a join.
    """
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).where("__gone is not null").distinct()
    own = col(id_col).cast("long")
    packed = bloom_filter(gone)
    if packed is None:
        return df.join(gone, own == F.col("__gone"), "left_anti")
    sent = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def maybe(x):
        import pandas as pd

        return pd.Series(in_filter(sent.value, x.to_numpy(np.int64)))

    told = df.withColumn("__maybe", maybe(F.coalesce(own, F.lit(-(1 << 63)))) & own.isNotNull())
    rest = told.where("__maybe").join(gone, own == F.col("__gone"), "left_anti")
    return told.where("not __maybe").union(rest).drop("__maybe")
