"""Benchmark decontamination: containment search with MinHash sketches sized by partitions of item length.

Items are partitioned by the number of their shingles. An item's sketch is its bottom-k MinHash: the k smallest
hashes of its shingle set, with k set by the partition's largest size so that a document which holds at least the
threshold's share of the item's shingles must hold one of the sketch (it misses too few to miss all). The search is
therefore lossless however long the document is, where a banded signature of the document would dilute a short item.
Candidates are verified by the exact share of shingles, compared as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Cuts, col, mix, shingles, texts, without_ids, words

STEP = np.uint64(0x9E3779B97F4A7C15)
MET = 10_000  #: items whose shingle sets a task keeps


class Vocabulary(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def shingle_hashes(w: list[bytes], k: int, seen: Vocabulary) -> np.ndarray:
    """A 64-bit hash of each of shingles(w, k)."""
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(w))):
        out = (out + h[i : i + n]) * STEP
        out ^= out >> np.uint64(29)
    return mix(out)


def sketch(w: list[bytes], k: int, threshold: float, seen: Vocabulary) -> np.ndarray:
    """The bottom-k sketch of an item's shingles, k by its size partition."""
    own = np.unique(shingle_hashes(w, k, seen))
    largest = 1 << (len(own) - 1).bit_length() if len(own) else 0  # of the item's size partition: (largest / 2, largest]
    return own[: math.floor((1 - threshold) * largest + 1e-9) + 1]


class Items:
    """A block of items: their sorted sketch hashes with the item of each; an item's shingle set is made when it is first met."""

    def __init__(self, keys: list[bytes], lines: list[bytes], sketches: list[np.ndarray], k: int):
        hashes = np.concatenate([np.zeros(0, np.uint64), *sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.repeat(np.arange(len(lines)), [len(x) for x in sketches])[order]
        self.keys, self.lines, self.k, self.sets = keys, lines, k, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sets": {}}

    def near(self, h: np.ndarray) -> np.ndarray:
        """The items with some sketch hash among h."""
        if not len(self.hashes) or not len(h):
            return self.owner[:0]
        lo = np.searchsorted(self.hashes, h)
        hit = np.unique(h[self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h])
        lo, hi = np.searchsorted(self.hashes, hit), np.searchsorted(self.hashes, hit, "right")
        return np.unique(np.concatenate([self.owner[:0], *(self.owner[x:y] for x, y in zip(lo, hi, strict=True))]))

    def shingles(self, n: int) -> frozenset:
        if n not in self.sets:
            if len(self.sets) >= MET:
                self.sets.clear()
            self.sets[n] = frozenset(shingles(self.lines[n].split(b" "), self.k))
        return self.sets[n]


FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("shared", pa.int64()), ("item_shingles", pa.int64())])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, threshold: float = 0.8, block_shingles: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for each document that holds at least threshold of an item's distinct k-word shingles.

    Words are ASCII-lower-cased. A text of fewer than k words is one shingle, its whole sequence: so short an item is
    found where a document is that sequence, not inside longer ones. Items or documents without words match nothing;
    null ids pass through as null. Items of the same words (by 128-bit digests) are searched for once. They are taken in blocks of about
    block_shingles words: each block is sent to all tasks, which read the documents once for it, without a shuffle, and
    the driver holds one block at a time. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "items")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Vocabulary()
        for b in batches:
            split = [words(t) for t in texts(b.column(1))]
            lines = [b" ".join(w) for w in split]
            found = [sketch(w, k, threshold, seen).tobytes() for w in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in lines], pa.binary()), pa.array(lines, pa.binary()), pa.array([len(w) for w in split], pa.int64()), pa.array(found, pa.binary())], ["i", "key", "line", "n", "sketch"])

    named = items.select(col(item_col).cast("long").alias("i"), col(item_text_col).cast("string").alias("t"))
    named = cuts.cut(named.mapInArrow(sketched, "i long, key binary, line binary, n long, sketch binary").where("n > 0"))
    wanted = cuts.cut(named.groupBy("key").agg(F.first("line").alias("line"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    blocks = max(1, math.ceil((wanted.agg(F.sum("n")).first()[0] or 0) / block_shingles))
    kept = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    path = f"{cuts.base}/found"
    for n in range(blocks):
        keys, lines, found = (c.to_pylist() for c in wanted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == n).select("key", "line", "sketch").toArrow().columns)
        sent = spark.sparkContext.broadcast(Items(keys, lines, [np.frombuffer(x, np.uint64) for x in found], k))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, seen = sent.value, Vocabulary()
            for b in batches:
                out: list[dict] = []
                for i, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                    w = words(t)
                    near = own.near(shingle_hashes(w, k, seen))
                    have = set(shingles(w, k)) if len(near) else set()
                    for x in near.tolist():
                        item = own.shingles(x)
                        shared = len(have & item)
                        if shared >= threshold * len(item) - 1e-9:
                            out.append({"doc_id": i, "key": own.keys[x], "shared": shared, "item_shingles": len(item)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, FOUND)

        kept.mapInArrow(run, "doc_id long, key binary, shared long, item_shingles long").write.mode("append").parquet(path)
        sent.unpersist()
    hits = spark.read.schema("doc_id long, key binary, shared long, item_shingles long").parquet(path)
    return hits.join(named.select("key", F.col("i").alias("item_id")), "key").select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without those that contain a benchmark item (see search). Rows with a null id stay."""
    cuts = Cuts(docs.sparkSession, "leaks")
    return without_ids(docs, id_col, cuts.cut(search(docs, items, id_col, **how).select("doc_id")))
