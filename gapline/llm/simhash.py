"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are dealt out as tries that begin, in turn, with each of budget + 1 blocks of bits: a pair within the
budget agrees wholly in one block at least, so in one of these rotated tries both stand below the same node. From
there a task walks down pairs of nodes together, adds up differing bits, and drops a pair once the budget is spent.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Cuts, bloom_filter, col, components, forest, in_filter, mix, partitions, shingles, texts, without, without_ids, words

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
SMALL = 64  #: pairs of nodes with at most so many pairs of fingerprints are compared directly
UNIT_BYTES = 8 << 20  #: of shingle sets, and 640 for each, in a chunk of a candidate group; two chunks at most are compared at a time
CHUNK = 1 << 16  #: pairs of nodes expanded at a time


def majority(hashes: bytes | np.ndarray) -> int:
    """64 bits of big-endian hashes: 1 where set in over half of them; 0 without hashes."""
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    if not len(h):
        return 0
    if len(h) < 256:
        n = np.unpackbits(h, axis=1).sum(0, dtype=np.int64)
    else:
        n = np.concatenate([np.bincount(h[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * n > len(h)).tobytes(), "big")


def simhash(text: bytes, k: int = 3) -> int:
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(s, 42) for s in shingles(words(text), k)]))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, fp): one row per row of docs, fp a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(simhash(t, k)) for t in texts(b.column(1))], pa.int64())], ["id", "fp"])

    kept = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, fp long")


def node_pairs(fp: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of sorted distinct uint64 fp that share their first depth bits and differ in at most budget bits, with their distance."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, (fp[1:] >> np.uint64(64 - depth)) != (fp[:-1] >> np.uint64(64 - depth))]) if depth else np.array([0])
    last = np.r_[first[1:], n]
    own = last - first > 1
    start = (first[own], last[own], first[own], last[own], np.zeros(own.sum(), np.int64))
    stack = [(depth, start)]
    while stack:
        d, (al, ah, bl, bh, err) = stack.pop()
        if len(al) > CHUNK:
            stack += [(d, tuple(x[k : k + CHUNK] for x in (al, ah, bl, bh, err))) for k in range(0, len(al), CHUNK)]
            continue
        small = (ah - al) * (bh - bl) <= SMALL if d < 64 else np.ones(len(al), bool)
        if small.any():
            a, b, m = al[small], bl[small], bh[small] - bl[small]
            size = (ah[small] - a) * m
            who = np.repeat(np.arange(len(a)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = a[who] + at // m[who], b[who] + at % m[who]
            dist = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
            ok = (i < j) & (dist <= budget)
            yield i[ok], j[ok], dist[ok]
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        low, bit = np.uint64(64 - d), np.uint64(1 << (63 - d))
        cut = lambda lo, low=low, bit=bit: np.searchsorted(fp, ((fp[lo] >> low) << low if low < 64 else np.zeros(len(lo), np.uint64)) | bit)
        am, bm, self_ = cut(al), cut(bl), (al == bl)
        parts = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, None), (am, ah, bl, bm, err + 1, ~self_)]
        kids = []
        for cl, ch, dl, dh, e, only in parts:
            ok = (ch > cl) & (dh > dl) & (e <= budget) & ~((cl == dl) & (ch - cl == 1))
            if only is not None:
                ok &= only
            kids.append(tuple(x[ok] for x in (cl, ch, dl, dh, e)))
        stack.append((d + 1, tuple(np.concatenate(x) for x in zip(*kids, strict=True))))


def rotations(fp: Column, budget: int) -> tuple[Column, int]:
    """fp turned so that each of budget + 1 blocks comes first; how many bits each block has at least."""
    width = 64 // (budget + 1)
    turned = [fp if not r else F.shiftleft(fp, r * width).bitwiseOR(F.shiftrightunsigned(fp, 64 - r * width)) for r in range(budget + 1)]
    return F.array(*turned), width


def hamming_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b, table) between distinct fingerprints fps(fp[, table]) that differ in at most budget bits.

    Each task returns a spanning forest of the links that it finds, so a dense group gives no more rows than it has
    fingerprints, and no component is lost.
    """
    if not 0 <= budget < 16:
        raise ValueError("budget: 0 to 15 bits")
    turned, width = rotations(F.col("fp"), budget)
    has_table = "table" in fps.columns
    dealt = fps.select(F.col("table").cast("int") if has_table else F.lit(0).alias("table"), F.posexplode(turned).alias("turn", "fp"))
    dealt = dealt.repartition(partitions(fps.sparkSession), "table", "turn", F.shiftrightunsigned("fp", 64 - width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, r, f = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in range(3))
        f = f.view(np.uint64)
        for table in np.unique(t):
            for turn in np.unique(r):
                fp = np.unique(f[(t == table) & (r == turn)])
                if len(fp) < 2:
                    continue
                label = np.arange(len(fp))
                for i, j, _ in node_pairs(fp, width, budget):
                    if len(i):
                        kept = np.flatnonzero(label != np.arange(len(fp)))
                        label = forest(len(fp), np.r_[i, kept], np.r_[j, label[kept]])
                a = np.flatnonzero(label != np.arange(len(fp)))
                b = label[a]
                s = np.uint64(int(turn) * width)
                back = (lambda x, s=s: (x >> s) | (x << (np.uint64(64) - s))) if turn else (lambda x: x)
                yield pa.RecordBatch.from_arrays([pa.array(back(fp[a]).view(np.int64)), pa.array(back(fp[b]).view(np.int64)), pa.array(np.full(len(a), table, np.int32))], ["a", "b", "table"])

    return dealt.mapInArrow(run, "a long, b long, table int")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Words are ASCII-lower-cased; null and empty texts have fingerprint zero and link like any other. A component's
    id is its smallest doc_id; null ids are never smallest, and a component of null ids has a null id. Repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    cuts = Cuts(docs.sparkSession, "simhash")
    fps = cuts.cut(fingerprints(docs, id_col, text_col, k))
    each = cuts.cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(cuts, hamming_links(each.select("fp"), budget))
    joined = each.join(roots, each.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = joined.join(lows, "root").select(F.col("fp").alias("f"), "component_id")
    out = fps.join(by_fp, fps.fp == by_fp.f)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies of whole documents: the trie join and bands of MinHash values find candidates, exact shingle similarity decides.


def band_keys(grams: list[bytes], bands: int, rows: int) -> list[int]:
    """A key for each band of rows MinHash values over a set of shingles; none without shingles."""
    if not grams:
        return []
    h = np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in grams], np.uint64))
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flip, times = seeds[: bands * rows], seeds[bands * rows :] | np.uint64(1)
    least = np.full(bands * rows, np.uint64((1 << 64) - 1))
    for k in range(0, len(h), 512):
        least = np.minimum(least, ((h[k : k + 512, None] ^ flip) * times).min(0))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = mix(key + column)
    return key.view(np.int64).tolist()


def similar_links(sets: list[np.ndarray], side: np.ndarray, similarity: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link all sets of distinct values with a Jaccard similarity of at least similarity, as a spanning forest.

    Where side holds both 0 and 1, no two sets of side 0 are compared, and where it holds 2 too, no two of one side. Every other pair
    whose sizes allow it is compared exactly, unless its sets are linked already; sets of one label are so from the start.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    flat = np.unique(np.concatenate([sets[n] for n in order]), return_inverse=True)[1]
    start = np.r_[0, np.cumsum(size)]
    mark = np.zeros(flat.max(initial=-1) + 1, np.int8)
    label = np.arange(len(sets)) if label is None else np.unique(label[order], return_inverse=True)[1]
    kinds = set(side.tolist())
    alone = {k for k in kinds if 2 in kinds or (k == 0 and 1 in kinds)}  # sides within which nothing is compared
    out = []
    for n in range(len(sets) - 1):
        end = int(np.searchsorted(size * similarity, size[n] + 1e-9, "right"))
        other = label[n + 1 : end] != label[n]
        if int(side[n]) in alone:
            other &= side[n + 1 : end] != side[n]
        to = n + 1 + np.flatnonzero(other)
        if not len(to):
            continue
        own = flat[start[n] : start[n + 1]]
        mark[own] = 1
        if 2 * len(to) > end - n:
            both = np.add.reduceat(mark[flat[start[n + 1] : start[end]]], start[n + 1 : end] - start[n + 1], dtype=np.int64)[to - n - 1]
        else:
            at = np.r_[0, np.cumsum(size[to])]
            both = np.add.reduceat(mark[flat[np.repeat(start[to] - at[:-1], size[to]) + np.arange(at[-1])]], at[:-1], dtype=np.int64)
        mark[own] = 0
        near = to[both >= similarity * (size[n] + size[to] - both) - 1e-9]
        if len(near):
            found, first = np.unique(label[near], return_index=True)
            out += [(int(order[n]), int(order[m])) for m in near[first]]
            label[np.isin(label, found)] = label[n]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, budget: int = 3, bands: int = 40, rows: int = 5) -> DataFrame:
    """(doc_id, component_id, n_rows): groups linked by a Jaccard similarity of k-word shingle sets of at least similarity.

    Documents with equal lower-cased word sequences form one class first. Candidates are classes whose SimHash fingerprints
    differ in at most budget bits, by the trie join, and, as that misses most pairs with a block added or cut, classes
    that share a band of rows MinHash values of their shingle sets: whatever the edit, scattered words or a whole block, a pair of
    similarity s is missed with a probability of about (1 - s**rows)**bands, with the defaults 1.2e-7 at 0.8 and less
    above. Groups that candidates link are compared pair by pair on exact shingle sets, but for pairs that others link
    already, so no pair below the threshold is ever linked. A group of many chunks is first compared chunk by chunk with
    one of them; then what isn't in its largest class is compared with all of it. n_rows counts the rows of the doc_id. Texts without words
    form one class. Rows with a null id stand alone (component_id null).
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "neardup")

    digest = xxhash.xxh64_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps, found = [], [], []
            for t in texts(b.column(1)):
                w = words(t)
                grams = shingles(w, k)
                keys.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest())
                fps.append(signed(majority(b"".join([digest(s, 42) for s in grams]))))
                found.append(band_keys(grams, bands, rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "cls", "fp", "bands"])

    kept = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    each = cuts.cut(kept.mapInArrow(run, "id long, cls binary, fp long, bands array<long>"))
    each = each.where("id is not null")
    low = cuts.cut(each.groupBy("cls").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    # classes whose fingerprints the trie join finds within the budget
    some = low.where(F.size("bands") > 0)
    by_fp = cuts.cut(some.groupBy("fp").agg(F.min("rep").alias("x"), F.max("rep").alias("last")))
    one, other = by_fp.select(F.col("fp").alias("a"), "x"), by_fp.select(F.col("fp").alias("b"), F.col("x").alias("y"))
    linked = hamming_links(by_fp.select("fp"), budget).join(one, "a").join(other, "b").select("x", "y")
    alike = some.join(by_fp.where("x <> last").select("fp", "x"), "fp").where("rep <> x").select("x", F.col("rep").alias("y"))
    # classes with the same key of some band, each with the smallest class of that key
    flat = low.select("rep", F.explode("bands").alias("key"))
    shared = flat.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("last")).where("x <> last").select("key", "x")
    banded = flat.join(shared, "key").where("rep <> x").select("x", F.col("rep").alias("y"))
    pairs = cuts.cut(linked.union(alike).union(banded).distinct())

    # Sets of the documents in some pair; a bounded filter spares the others' texts the exchange.
    groups = components(cuts, pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    groups = groups.union(groups.select("root", "root").distinct())
    maybe = spark.sparkContext.broadcast(bloom_filter(groups.select("node")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if maybe.value is not None:
                b = b.filter(pa.array(in_filter(maybe.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            out = []
            for t in texts(b.column(1)):
                out.append(np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles(words(t), k)], np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "s"])

    held = kept.where("id is not null").select("id", "text").mapInArrow(sets, "id long, s binary")
    held = cuts.cut(held.join(groups, held.id == groups.node).select("id", "s", "root").dropDuplicates(["id"]))
    # A group in chunks: a task compares one with itself and with the group's chunk 0; mostly there is one chunk.
    size = F.octet_length("s") + 640
    chunks = cuts.cut(held.groupBy("root").agg(F.ceil(F.sum(size) / UNIT_BYTES).cast("int").alias("chunks")))
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = held.join(chunks, "root").withColumn("c", chunk("chunks"))
    none = F.lit(None).cast("long").alias("label")
    first = own.where("c = 0 and chunks > 1").select("root", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)).alias("c"), F.lit(0).alias("d"), F.lit(0).alias("side"), "id", "s", none)
    units = own.select("root", "c", F.lit(0).alias("d"), F.lit(1).alias("side"), "id", "s", none).union(first)

    def links(unit: list[tuple]) -> list[tuple[int, int]]:
        ids, side = [u[1] for u in unit], np.array([u[0] for u in unit])
        label = None if unit[0][3] is None else np.array([u[3] for u in unit])
        return [(ids[x], ids[y]) for x, y in similar_links([np.frombuffer(u[2], np.uint64) for u in unit], side, similarity, label)]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, []
        for b in itertools.chain(batches, [None]):
            good = []
            for root, c, d, side, id_, v, label in zip(*(x.to_pylist() for x in b.columns), strict=True) if b is not None else [(None,) * 7]:
                if (root, c, d) != now:
                    good += links(unit) if len(unit) > 1 else []
                    now, unit = (root, c, d), []
                if v:
                    unit.append((side, id_, v, label))
            yield pa.RecordBatch.from_arrays([pa.array([g[n] for g in good], pa.int64()) for n in (0, 1)], ["a", "b"])

    def compared(units: DataFrame) -> DataFrame:
        return cuts.cut(units.repartition(partitions(spark), "root", "c", "d").sortWithinPartitions("root", "c", "d", "side", "id").mapInArrow(within, "a long, b long"))

    good = compared(units)
    roots = components(cuts, good)
    if not chunks.where("chunks > 1").isEmpty():
        # What of a group in several chunks isn't in its largest class so far meets the whole group, but for its own class.
        large = held.join(chunks.where("chunks > 1"), "root").join(roots.withColumnRenamed("root", "label"), held.id == roots.node, "left")
        large = cuts.cut(large.select("root", "chunks", "id", "s", F.coalesce("label", "id").alias("label")))
        most = large.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("n")).where("n > 1")
        rest = large.join(most.select("root", "main"), "root").where("label <> main")
        parts = rest.groupBy("root").agg(F.ceil(F.sum(size) / UNIT_BYTES).cast("int").alias("parts"))
        to = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")
        asked = rest.join(parts, "root").select("root", to, chunk("parts").alias("d"), F.lit(0).alias("side"), "id", "s", "label")
        every = large.join(parts, "root").select("root", chunk("chunks").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d"), F.lit(2).alias("side"), "id", "s", "label")
        roots = components(cuts, good.union(compared(asked.union(every))))
    reps = low.join(roots, low.rep == roots.node, "left").select("cls", F.coalesce("root", "rep").alias("component_id"))
    out = each.groupBy("id", "cls").agg(F.count("*").alias("n_rows")).join(reps, "cls")
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.min("component_id").alias("component_id"), F.sum("n_rows").alias("n_rows"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs less all but one document of each group of near duplicates; the smallest id stays.

    Rows without an id stay. Of several rows with the id that stays, one remains.
    """
    cuts = Cuts(docs.sparkSession, "keepone")
    classes = cuts.cut(near_duplicates(docs, id_col, text_col, **how))
    once = without_ids(docs, id_col, classes.where("doc_id <> component_id").select("doc_id"))
    repeated = classes.where("doc_id = component_id and n_rows > 1").select("doc_id")
    if repeated.isEmpty():
        return once
    several = once.join(repeated.withColumnRenamed("doc_id", "__several"), col(id_col).cast("long") == F.col("__several"))
    return without_ids(once, id_col, repeated).unionByName(without(several.dropDuplicates(["__several"]), "__several"))
