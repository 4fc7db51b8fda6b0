"""An index as Parquet tables under one folder, and the whole of it or some lists read back; records as packed bytes."""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapline.operators.fit import CHUNK
from gapline.sources.collections import opened

BUCKETS = 64


def save(table: DataFrame, folder: str, buckets: int = BUCKETS, extra: dict[str, DataFrame] | None = None, name: str = "segments", order: str = "first") -> None:
    """table(list_id, ...) by buckets of lists, so that a query reads the buckets of its lists only; extra tables beside it."""
    bucket = F.pmod(F.xxhash64("list_id"), F.lit(buckets)).cast("int")
    table.withColumn("list_bucket", bucket).repartition("list_bucket", F.expr("list_id div 16")).sortWithinPartitions("list_bucket", "list_id", order).write.partitionBy("list_bucket").mode("overwrite").parquet(f"{folder}/{name}")
    table.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{folder}/meta")
    for other, df in (extra or {}).items():
        df.write.mode("overwrite").parquet(f"{folder}/{other}")


def load(spark: SparkSession, folder: str, lists: DataFrame | None = None, name: str = "segments") -> DataFrame:
    """The whole table, or the rows of lists(list_id): buckets are pruned while the plan runs."""
    all_ = spark.read.parquet(f"{folder}/{name}")
    if lists is None:
        return all_.drop("list_bucket")
    buckets = spark.read.parquet(f"{folder}/meta").first().buckets
    wanted = lists.select("list_id").distinct().withColumn("list_bucket", F.pmod(F.xxhash64("list_id"), F.lit(buckets)).cast("int"))
    return all_.join(wanted, ["list_bucket", "list_id"]).drop("list_bucket")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is, a temporary one is set in a local session; on a cluster, whose
    executors need not share such a folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gapline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/gapline/{name}-{uuid.uuid4().hex}"


def missing(segments: DataFrame, lists: DataFrame) -> DataFrame:
    """(list_id) asked for but not in the index."""
    return lists.select("list_id").distinct().join(segments.select("list_id").distinct(), "list_id", "left_anti")


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of width bits each, low bits first, in whole 64-bit words."""
    if not width or not len(values):
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    flat = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return flat + b"\0" * (-len(flat) % 8)


def unpack(data: bytes, n: int, width: int, skip: int = 0) -> np.ndarray:
    """n values of width bits each, behind skip bits."""
    if not width or not n:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip : skip + n * width].reshape(n, width).astype(np.uint64)
    return (bits << np.arange(width, dtype=np.uint64)).sum(1).astype(np.int64)


FIELDS = ("covered", "delta_y", "delta_x", "y_b", "x_b")
PARTS = ["list_id", "block_id", "name", "at", "count", "key", "n"]  #: of a record file: segments from at on, whose keys begin at key
HEAD = struct.calcsize("<IQI5B")
STEP = 1 << 16  #: values packed, or keys handed on, at a time; whole words of any width
SPOOL = 4 << 20  #: bytes of a block that a task holds


def record(epsilon: int, segments: list[dict]) -> bytes:
    """A block's record: epsilon, keys, segments, widths, the five packed parameters, packed magnitudes, and sign bits."""
    cols = {f: np.array([s[f] for s in segments], np.int64) for f in FIELDS}
    width = {f: int(cols[f].max()).bit_length() for f in FIELDS}
    r = np.concatenate([np.array(s["residuals"], np.int64) for s in segments])
    out = [struct.pack("<IQI5B", epsilon, len(r), len(segments), *(width[f] for f in FIELDS))]
    for f in FIELDS:
        data = pack(cols[f], width[f])
        out.append(struct.pack("<Q", len(data) // 8) + data)
    data = pack(np.abs(r), int(epsilon).bit_length())
    signs = np.packbits(r < 0, bitorder="little").tobytes()
    return b"".join([*out, struct.pack("<Q", len(data) // 8), data, struct.pack("<Q", len(r)), signs])


def parse(data: bytes) -> tuple[int, list[dict]]:
    epsilon, n, count, *widths = struct.unpack_from("<IQI5B", data)
    at, cols = struct.calcsize("<IQI5B"), {}

    def words() -> bytes:
        nonlocal at
        size = 8 * struct.unpack_from("<Q", data, at)[0]
        at += 8 + size
        return data[at - size : at]

    for f, w in zip(FIELDS, widths, strict=True):
        cols[f] = unpack(words(), count, w)
    r = unpack(words(), n, epsilon.bit_length())
    signs = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 8), bitorder="little")[:n].astype(bool)
    r = np.where(signs, -r, r)
    out, k = [], 0
    for i in range(count):
        own = {f: int(cols[f][i]) for f in FIELDS}
        out.append(own | {"first": k, "residuals": r[k : k + own["covered"]].tolist()})
        k += own["covered"]
    return epsilon, out


def export(segments: DataFrame) -> DataFrame:
    """(list_id, block_id, part, start, record): a packed record for each part of a block.

    A part is what was fitted as one unit, at most CHUNK keys from position start on, so no record grows with its list.
    """
    own = F.struct("first", *FIELDS, "residuals")
    begin = segments.groupBy("list_id", "block_id").agg(F.min("first").alias("begin"))
    unit = segments.join(begin, ["list_id", "block_id"]).withColumn("part", F.expr(f"(first - begin) div {CHUNK}"))
    grouped = unit.groupBy("list_id", "block_id", "part", "epsilon").agg(F.min("first").alias("start"), F.array_sort(F.collect_list(own)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [record(e, s) for e, s in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(made, pa.binary())], ["list_id", "block_id", "part", "start", "record"])

    return grouped.mapInArrow(run, "list_id bigint, block_id bigint, part bigint, start bigint, record binary")


def restore(records: DataFrame) -> DataFrame:
    """Segments of export's records, less first_value and last_value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, start, data in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3)), strict=True):
                epsilon, own = parse(data)
                n = len(own)
                cols = [pa.array([x] * n, pa.int64()) for x in (i, j, epsilon)] + [pa.array([start + s["first"] for s in own], pa.int64())]
                cols += [pa.array([s[f] for s in own], pa.int64()) for f in FIELDS] + [pa.array([s["residuals"] for s in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["list_id", "block_id", "epsilon", "first", *FIELDS, "residuals"])

    schema = ", ".join(f"{c} bigint" for c in ("list_id", "block_id", "epsilon", "first", *FIELDS))
    return records.select("list_id", "block_id", "start", "record").mapInArrow(run, f"{schema}, residuals array<bigint>")


class Block:
    """A block's record, made of segments as they come; what grows with the block is kept in local temporary files beyond SPOOL bytes."""

    def __init__(self, epsilon: int):
        self.epsilon, self.n, self.count, self.most = epsilon, 0, 0, np.zeros(len(FIELDS), np.int64)
        self.own, self.sizes, self.signs = (tempfile.SpooledTemporaryFile(SPOOL) for _ in range(3))
        self.held: list[np.ndarray] = []  # residuals not yet packed
        self.waiting = 0

    def add(self, own: np.ndarray, residuals: np.ndarray) -> None:
        """own: a row of FIELDS for each segment."""
        self.own.write(own.astype("<i8").tobytes())
        self.most, self.count = np.maximum(self.most, own.max(0)), self.count + len(own)
        self.held.append(residuals)
        self.n, self.waiting = self.n + len(residuals), self.waiting + len(residuals)
        if self.waiting >= STEP:
            self._pack(self.waiting - self.waiting % 64)  # whole words

    def _pack(self, n: int) -> None:
        r = np.concatenate([np.zeros(0, np.int64), *self.held])
        for at in range(0, n, STEP):
            some = r[at : min(at + STEP, n)]
            self.sizes.write(pack(np.abs(some), int(self.epsilon).bit_length()))
            self.signs.write(np.packbits(some < 0, bitorder="little").tobytes())
        self.held, self.waiting = [r[n:].copy()], len(r) - n

    def bytes(self) -> Iterator[bytes]:
        """What record gives of all segments, piece by piece."""
        self._pack(self.waiting)
        width = [int(x).bit_length() for x in self.most]
        yield struct.pack("<IQI5B", self.epsilon, self.n, self.count, *width)
        for f, w in enumerate(width):
            yield struct.pack("<Q", n_words(self.count, w))
            self.own.seek(0)
            while data := self.own.read(8 * len(FIELDS) * STEP):
                yield pack(np.frombuffer(data, "<i8").reshape(-1, len(FIELDS))[:, f], w)
        yield struct.pack("<Q", n_words(self.n, int(self.epsilon).bit_length()))
        yield from self._again(self.sizes)
        yield struct.pack("<Q", self.n)
        yield from self._again(self.signs)

    @staticmethod
    def _again(file) -> Iterator[bytes]:
        file.seek(0)
        while data := file.read(SPOOL):
            yield data

    def close(self) -> None:
        for file in (self.own, self.sizes, self.signs):
            file.close()


def n_words(n: int, width: int) -> int:
    """64-bit words of n packed values."""
    return -(-n * width // 64)


def save_idx(segments: DataFrame, folder: str, parted: bool = True) -> None:
    """Lists 0 .. n - 1 as record files, <list>_<block>.idx (or <list>.idx, not parted, of one block each), and the header idx.size.

    The header holds the number of keys (64 bits) and of lists (32), and, parted, the blocks of each list (64 each). A file is one
    block's record, written from a stream of its segments under a temporary name; when all are whole they are renamed, so a repeated
    attempt gives the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        now, block = None, None

        def ended() -> pa.RecordBatch:
            temp = f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                for data in block.bytes():
                    out.write(data)
            block.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now[:2], block.n, temp)], ["list_id", "block_id", "n", "temp"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in ("list_id", "block_id", "epsilon")], 1)
            own, r = np.stack([b.column(f).to_numpy() for f in FIELDS], 1), b.column("residuals")
            ends, values = r.offsets.to_numpy(), r.values.to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]).tolist()
            for x, y in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if tuple(key[x].tolist()) != now:
                    if block:
                        yield ended()
                    now = tuple(key[x].tolist())
                    block = Block(now[2])
                block.add(own[x:y], values[ends[x] : ends[y]])
        if block:
            yield ended()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        for b in batches:
            for i, j, temp in zip(*(b.column(c).to_pylist() for c in ("list_id", "j", "temp")), strict=True):
                if j and not parted:
                    raise ValueError(f"list {i} has several blocks")
                path = f"{base}/{i}_{j}.idx" if parted else f"{base}/{i}.idx"
                if store.get_file_info(temp).is_file or not store.get_file_info(path).is_file:  # else an attempt before this one has renamed it
                    store.move(temp, path)
            yield b.select(["list_id", "n"])

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        ids, blocks, n = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(([], [], []), *((b.column(k).to_numpy() for k in range(3)) for b in batches), strict=True))
        if not np.array_equal(ids, np.arange(len(ids))):
            raise ValueError("lists aren't numbered from 0 without gaps")
        put(store, f"{base}/idx.size", [struct.pack("<QI", int(n.sum()), len(ids)), blocks.astype("<u8").tobytes() if parted else b""])
        yield pa.RecordBatch.from_arrays([pa.array([len(ids)])], ["lists"])

    rows = segments.select("list_id", "block_id", "epsilon", "first", *FIELDS, "residuals").repartition("list_id", "block_id").sortWithinPartitions("list_id", "block_id", "first")
    made = rows.mapInArrow(write, "list_id bigint, block_id bigint, n bigint, temp string")
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("block_id")) - 1
    named = made.withColumn("j", place.cast("bigint")).mapInArrow(name, "list_id bigint, n bigint")
    sizes = named.groupBy("list_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"))
    if not sizes.repartition(1).sortWithinPartitions("list_id").mapInArrow(header, "lists bigint").collect():
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        put(store, f"{base}/idx.size", [struct.pack("<QI", 0, 0)])


def put(store, path: str, data: list[bytes]) -> None:
    temp = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as out:
        for x in data:
            out.write(x)
    store.move(temp, path)


class RecordFile:
    """A record in a file, of which runs of segments are read: where its parts begin, as its head and their numbers of words say."""

    def __init__(self, file, path: str):
        self.file = file
        head, size = file.read(HEAD), file.size()
        self.epsilon, self.n, self.count, *self.width = struct.unpack("<IQI5B", head) if len(head) == HEAD else (0, 0, 0, *[0] * len(FIELDS))
        self.begin, at = [], HEAD
        for n, w in [*((self.count, w) for w in self.width), (self.n, self.epsilon.bit_length())]:
            self.begin.append(at + 8)
            at += 8 + 8 * n_words(n, w)
        self.begin.append(at + 8)
        if len(head) < HEAD or size != at + 8 + -(-self.n // 8):
            raise ValueError(f"{path}: {size} bytes, which aren't what its head says")

    def column(self, k: int, width: int, at: int, n: int) -> np.ndarray:
        """Values at .. at + n - 1 of the k-th part."""
        out = [np.zeros(0, np.int64)]
        for x in range(at, at + n if width else at, STEP):
            some = min(STEP, at + n - x)
            byte, skip = divmod(x * width, 8)
            self.file.seek(self.begin[k] + byte)
            out.append(unpack(self.file.read(-(-(skip + some * width) // 8)), some, width, skip))
        return np.concatenate(out) if width else np.zeros(n, np.int64)

    def covered(self, at: int, n: int) -> np.ndarray:
        return self.column(0, self.width[0], at, n)

    def residuals(self, at: int, n: int) -> np.ndarray:
        r = self.column(len(FIELDS), self.epsilon.bit_length(), at, n)
        return np.where(self.column(len(FIELDS) + 1, 1, at, n) == 1, -r, r)


def load_idx(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of save_idx's files, less first_value and last_value; block_id counts the blocks of a list. Files that the header doesn't name, or lacks, are an error.

    Executors walk the lengths of each file's segments, and read runs of segments of about CHUNK keys.
    """
    store, base = opened(folder)
    named = [(x.base_name, re.fullmatch(r"([0-9]+)(?:_([0-9]+))?\.idx", x.base_name)) for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.endswith(".idx")]
    if strange := [x for x, m in named if not m]:
        raise ValueError(f"{folder}: {strange[0]} is not a list's name")
    files = spark.createDataFrame([(int(m[1]), int(m[2] or 0), x) for x, m in named], "list_id bigint, block_id bigint, name string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        for b in batches:
            for i, j, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    own, out, key = RecordFile(f, name), [], 0
                    for at in range(0, own.count, STEP):
                        keys = own.covered(at, min(STEP, own.count - at))
                        ends = np.cumsum(keys)
                        new = np.flatnonzero(np.r_[True, np.diff((ends - keys + key) // CHUNK) > 0])
                        out += [(i, j, name, at + x, y - x, key + int(ends[x] - keys[x]), int(keys[x:y].sum())) for x, y in zip(new.tolist(), [*new[1:].tolist(), len(keys)], strict=True)]
                        key += int(ends[-1])
                    if key != own.n:
                        raise ValueError(f"{name}: its segments cover {key} of {own.n} keys")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], PARTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        for b in batches:
            for i, j, name, at, count, key, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    file = RecordFile(f, name)
                    own = [file.column(k, w, at, count) for k, w in enumerate(file.width)]
                    ends = np.r_[0, np.cumsum(own[0])]
                    x = 0
                    while x < count:
                        y = max(x + 1, int(np.searchsorted(ends, ends[x] + STEP, "right")) - 1)
                        r = file.residuals(key + int(ends[x]), int(ends[y] - ends[x]))
                        cols = [pa.array(np.full(y - x, v)) for v in (i, j, file.epsilon)] + [pa.array(start + key + ends[x:y])] + [pa.array(c[x:y]) for c in own]
                        lists = pa.ListArray.from_arrays(pa.array((ends[x : y + 1] - ends[x]).astype(np.int32)), pa.array(r))
                        yield pa.RecordBatch.from_arrays([*cols, lists], ["list_id", "block_id", "epsilon", "first", *FIELDS, "residuals"])
                        x = y

    parts = files.repartition("list_id", "block_id").mapInArrow(walk, "list_id bigint, block_id bigint, name string, at bigint, count bigint, key bigint, n bigint")
    sizes = parts.groupBy("list_id", "block_id").agg(F.sum("n").alias("n"))
    with store.open_input_file(f"{base}/idx.size") as f:
        total, lists = struct.unpack_from("<QI", f.read(12))
    found = sizes.agg(F.sum("n").alias("n"), F.count_distinct("list_id").alias("lists")).first()
    if (found.n or 0, found.lists) != (total, lists):
        raise ValueError(f"{folder}: the header has {lists} lists of {total} keys, the files {found.lists} of {found.n}")
    before = F.sum("n").over(Window.partitionBy("list_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("list_id", "block_id", F.coalesce(before, F.lit(0)).alias("start"))
    placed = parts.join(starts, ["list_id", "block_id"]).select("list_id", "block_id", "name", "at", "count", "key", "start")
    schema = ", ".join(f"{c} bigint" for c in ("list_id", "block_id", "epsilon", "first", *FIELDS))
    return placed.repartition("list_id", "block_id", "at").mapInArrow(read, f"{schema}, residuals array<bigint>")
