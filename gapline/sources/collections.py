"""Collection files (.docs), query files (.queries) and key files, read on executors, and their writers.

A collection is little-endian 32-bit words: 1, the universe's size, then for each list its length and its ids.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20  #: keys read at a time
WALK = 1 << 16  #: bytes read at a time while only lengths are wanted
SPLIT = 64 << 20  #: bytes of a task
ROWS = 1 << 16  #: keys of a key file handed on at a time


def opened(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def created(path: str):
    """opened, for a file to be written: the folder that it goes to is made if need be."""
    store, base = opened(path)
    if folder := posixpath.dirname(base):
        store.create_dir(folder, recursive=True)
    return store, base


def files_of(path: str) -> list[str]:
    """A collection's files: path itself, or the .docs files of a folder in order of name."""
    from pyarrow import fs

    store, base = opened(path)
    if store.get_file_info(base).type != fs.FileType.Directory:
        return [path]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(x.base_name for x in store.get_file_info(fs.FileSelector(base))) if n.endswith(".docs")]


def lengths(path: str) -> Iterator[tuple[int, int]]:
    """The universe's size (with offset 0), then the offset of each list's first id and its length, by seeks past the ids; raises on a bad magic word or a file cut short."""
    store, base = opened(path)
    with store.open_input_file(base) as f:
        size, held, start = f.size(), b"", 0

        def word(at: int) -> int:
            nonlocal held, start
            if at + 4 > size:
                raise ValueError(f"{path}: cut short")
            if not start <= at <= start + len(held) - 4:
                f.seek(at)
                held, start = f.read(WALK), at
            return int.from_bytes(held[at - start : at - start + 4], "little")

        if word(0) != 1:
            raise ValueError(f"{path}: the first word is {word(0)}, not 1")
        yield 0, word(4)
        at = 8
        while at < size:
            n = word(at)
            if at + 4 + 4 * n > size:
                raise ValueError(f"{path}: cut short")
            yield at + 4, n
            at += 4 + 4 * n


class _Part(InputPartition):
    """From position pos of list ordinal, whose left ids begin at offset, up to offset end."""

    def __init__(self, path: str, offset: int, end: int, ordinal: int, pos: int, left: int):
        self.path, self.offset, self.end, self.ordinal, self.pos, self.left = path, offset, end, ordinal, pos, left


def parts_of(file: str, split: int) -> Iterator[_Part]:
    """Parts of about split bytes of one file, cut within lists too; ordinals count the file's lists."""
    if split < 4:
        raise ValueError("splitBytes: 4 or more")
    walk = lengths(file)
    next(walk)
    open_ = None
    for ordinal, (offset, n) in enumerate(walk):
        if open_ is None:
            open_ = _Part(file, offset, offset, ordinal, 0, n)
        end = offset + 4 * n
        while end - open_.offset > split:
            cut = max(offset, min(end, open_.offset + split - (open_.offset + split - offset) % 4))
            open_.end = cut
            yield open_
            open_ = _Part(file, cut, cut, ordinal, (cut - offset) // 4, (end - cut) // 4)
        open_.end = end
    if open_ is not None:
        yield open_


def keys_of(part: _Part) -> Iterator[pa.RecordBatch]:
    """(list_id, pos, doc_id) of a part."""
    store, base = opened(part.path)
    at, ordinal, pos, left = part.offset, part.ordinal, part.pos, part.left
    names = ["list_id", "pos", "doc_id"]
    with store.open_input_file(base) as f:
        f.seek(at)
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        while True:
            take = min(left, PIECE, (part.end - at) // 4)
            if take:
                held.append((np.full(take, ordinal), np.arange(pos, pos + take), np.frombuffer(f.read(4 * take), "<u4").astype(np.int64)))
                at, pos, left, rows = at + 4 * take, pos + take, left - take, rows + take
            if held and (rows >= PIECE or at >= part.end):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                held, rows = [], 0
            if at >= part.end:
                return
            if not left:
                left, ordinal, pos = int.from_bytes(f.read(4), "little"), ordinal + 1, 0
                at += 4


class _DocsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[InputPartition]:
        """Parts of all files; a walk on the driver, which read_docs does on executors instead."""
        out: list[_Part] = []
        base = 0
        for file in files_of(self.path):
            for part in parts_of(file, self.split):
                part.ordinal += base
                out.append(part)
            base += sum(1 for _ in lengths(file)) - 1
        return out

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else keys_of(partition)  # None: Spark's stand-in where there are no parts


class DocsSource(DataSource):
    """spark.read.format("docs").load(path): (list_id, pos, doc_id), a task for every splitBytes bytes; long lists are cut."""

    @classmethod
    def name(cls) -> str:
        return "docs"

    def schema(self) -> str:
        return "list_id bigint, pos bigint, doc_id bigint"

    def reader(self, schema) -> DataSourceReader:
        return _DocsReader(self.options)


def read_docs(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(list_id, pos, doc_id) of a collection, or of a folder's, numbered on from file to file.

    Executors walk the files, each in a stream of its lengths, for parts of split bytes; then the parts are dealt out and
    read. The driver lists the files and holds nothing of what is in them.
    """
    files = spark.createDataFrame(list(enumerate(files_of(path))), "file long, path string").repartition("file")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = [(file, name, p.offset, p.end, p.ordinal, p.pos, p.left, 0) for p in parts_of(name, split)]
                out.append((file, name, 0, 0, 0, 0, 0, sum(1 for _ in lengths(name)) - 1))
                yield pa.RecordBatch.from_pylist([dict(zip(fields, x, strict=True)) for x in out])

    fields = ["file", "path", "offset", "end", "ordinal", "pos", "left", "n_lists"]
    found = files.mapInArrow(walk, "file long, path string, offset long, end long, ordinal long, pos long, left long, n_lists long")
    before = F.sum("n_lists").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    base = found.where("end = 0").select("file", F.coalesce(before, F.lit(0)).alias("base"))
    parts = found.where("end > 0").join(base, "file").select("path", "offset", "end", (F.col("ordinal") + F.col("base")).alias("ordinal"), "pos", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from keys_of(_Part(*row))

    return parts.repartition("path", "offset").mapInArrow(read, "list_id bigint, pos bigint, doc_id bigint")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(universe_size, n_lists, n_postings) of a collection, from headers and lengths alone; of a folder, the largest universe and the sums."""
    files = spark.createDataFrame([(f,) for f in files_of(path)], "path string").repartition("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                walk = lengths(name)
                universe, n, total = next(walk)[1], 0, 0
                for _, size in walk:
                    n, total = n + 1, total + size
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (universe, n, total)], ["u", "n", "t"])

    each = files.mapInArrow(run, "u bigint, n bigint, t bigint")
    return each.agg(F.max("u").alias("universe_size"), F.sum("n").alias("n_lists"), F.sum("t").alias("n_postings"))


def write_docs(keyed: DataFrame, path: str, universe: int, files: int = 1) -> None:
    """A collection of keyed(list_id, pos, doc_id) with list ids 0 .. n - 1: one file, or a folder of at most so many files by ranges of lists.

    Each file is one task's stream, written under a temporary name and then renamed, so a repeated attempt gives the same file.
    """
    if files > 1:
        store, base = opened(path)
        store.create_dir(base, recursive=True)
    sizes = keyed.groupBy("list_id").agg(F.count("*").alias("n"))
    rows = keyed.join(sizes, "list_id").select("list_id", "pos", "doc_id", "n")
    rows = rows.repartitionByRange(files, "list_id") if files > 1 else rows.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(path) if files > 1 else created(path)
        temp, out, first = f"{base}{'/' if files > 1 else ''}_{uuid.uuid4().hex}", None, 0
        for b in batches:
            if not b.num_rows:
                continue
            pos, doc, n = (b.column(k).to_numpy() for k in (1, 2, 3))
            if out is None:
                out, first = store.open_output_stream(temp), int(b.column(0)[0].as_py())
                out.write(np.array([1, universe], "<u4").tobytes())
            starts = np.flatnonzero(pos == 0)
            out.write(np.insert(doc, starts, n[starts]).astype("<u4").tobytes())
        if out is not None:
            out.close()
            store.move(temp, f"{base}/lists-{first:012d}.docs" if files > 1 else base)
            yield pa.RecordBatch.from_arrays([pa.array([first])], ["first"])

    if not rows.sortWithinPartitions("list_id", "pos").mapInArrow(run, "first bigint").collect():
        store, base = opened(path) if files > 1 else created(path)
        with store.open_output_stream(f"{base}/lists-{0:012d}.docs" if files > 1 else base) as f:
            f.write(np.array([1, universe], "<u4").tobytes())


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, terms): a query per line, whole numbers up to the first word that isn't one, sorted and distinct.

    query_id counts lines, on from file to file in order of path where path names several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = []
                for line in (text or b"").decode().splitlines():
                    terms: set[int] = set()
                    for w in line.split():
                        if not w.isdigit():
                            break
                        terms.add(int(w))
                    out.append(sorted(terms))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array(np.arange(len(out))), pa.array(out, pa.list_(pa.int64()))], ["path", "line", "terms"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    lines = files.mapInArrow(run, "path string, line bigint, terms array<bigint>")
    before = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    base = lines.groupBy("path").agg(F.count("*").alias("n")).select("path", F.coalesce(before, F.lit(0)).alias("base"))
    return lines.join(F.broadcast(base), "path").select((F.col("base") + F.col("line")).alias("query_id"), "terms")


def write_queries(queries: DataFrame, path: str) -> None:
    """A text folder of queries, a line each in order of query_id."""
    queries.orderBy("query_id").select(F.array_join(F.transform("terms", lambda x: x.cast("string")), " ").alias("value")).write.text(path)


def key_parts(path: str, width: int) -> list[tuple[str, int, int]]:
    """(path, first, n) of runs of at most PIECE keys of a key file of width bytes a key; raises on a file cut short."""
    store, base = opened(path)
    with store.open_input_file(base) as f:
        n = int.from_bytes(f.read(8), "little")
        if f.size() < 8 + n * width:
            raise ValueError(f"{path}: cut short")
    return [(path, at, min(PIECE, n - at)) for at in range(0, n, PIECE)]


def read_keys(spark: SparkSession, path: str, bits: int = 32) -> DataFrame:
    """(pos, key) of a key file, a 64-bit count and then keys, numbered in order of key; of several files, each for itself.

    Executors read runs of PIECE keys. Where they find a file out of order, a sorted copy in the shared folder is read in its place.
    """
    from gapline.sources.store import scratch

    width = bits // 8
    named = spark.read.format("binaryFile").load(path).select("path").collect()
    files = [re.sub("^file:/(?!/)", "file:///", x.path) for x in sorted(named)]

    def keys(name: str, at: int, n: int) -> np.ndarray:
        store, base = opened(name)
        with store.open_input_file(base) as f:
            f.seek(8 + at * width)
            return np.frombuffer(f.read(n * width), f"<u{width}")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = keys(name, max(at - 1, 0), n + min(at, 1))
                if (k[1:] < k[:-1]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([name])], ["path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = keys(*part).astype(np.int64)
                for i in range(0, len(k), ROWS):
                    some = k[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(some)) + part[1] + i), pa.array(some)], ["pos", "key"])

    def rows(names: list[str]) -> DataFrame:
        return spark.createDataFrame([x for name in names for x in key_parts(name, width)], "path string, at long, n long")

    for x in rows(files).mapInArrow(check, "path string").distinct().collect():
        copy = scratch(spark, "keys")
        write_keys(rows([x.path]).mapInArrow(read, "pos bigint, key bigint"), copy, bits)
        files[files.index(x.path)] = copy
    return rows(files).mapInArrow(read, "pos bigint, key bigint")


def write_keys(keys: DataFrame, path: str, bits: int = 32) -> None:
    """A key file of keys(key), in order: keys are sorted and packed by ranges, and one task writes the pieces behind their count, under a temporary
    name until the file is whole. Keys are unsigned; null, or what has more bits than a key of the file, is an error."""
    n = keys.count()
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63))) if bits == 64 else F.col("key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i = TaskContext.get().partitionId(), 0
        for b in batches:
            if b.column(0).null_count:
                raise ValueError("a key is null")
            k = b.column(0).to_numpy()
            if bits < 64 and len(k) and (k.min() < 0 or k.max() >> bits):
                raise ValueError(f"a key has no {bits} bits: {k.min()} to {k.max()}")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, i, len(k), k.astype(f"<u{bits // 8}").tobytes())], ["part", "i", "n", "data"])
            i += 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = created(path)
        temp, held = f"{base}_{uuid.uuid4().hex}", 0
        with store.open_output_stream(temp) as out:
            out.write(n.to_bytes(8, "little"))
            for b in batches:
                for size, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    out.write(data)
                    held += size
        if held != n:
            raise ValueError(f"{path}: {n} keys were counted, {held} written")
        store.move(temp, base)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    ranges = keys.select(F.col("key").cast("bigint")).repartitionByRange(unsigned).sortWithinPartitions(unsigned)
    pieces = ranges.mapInArrow(pack, "part bigint, i bigint, n bigint, data binary")
    if not pieces.repartition(1).sortWithinPartitions("part", "i").mapInArrow(write, "n bigint").collect():
        store, base = created(path)
        with store.open_output_stream(base) as f:
            f.write(n.to_bytes(8, "little"))
