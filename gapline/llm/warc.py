"""A deterministic sharded WARC writer and its reader.

Records are put in order of page_id by histogram splitters (exact, so they don't depend on how rows are laid out) and
one exchange. Each task regenerates headers and digests, writes a gzip member per record, and rolls to a new file by
compressed size. A task attempt writes under temporary names of its own and reports its files as rows; Spark commits
those of one attempt only. Then the reported files get their final names, and the manifest is written last: readers go
by the manifest, so what a lost attempt has left behind is never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm.common import Cuts, col, new_path
from gapline.llm.sharding import exchange, split

NULL_LAST = (1 << 63) - 1
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, seq int, name string, temp string, n_records long, n_bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def safe(url: str | None, page_id: int | None) -> str:
    """url with control characters and spaces percent-encoded; a name of its own for a page without url."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit of page first, which has the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {safe(url, page_id)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"] + ([f"X-Refers-To-Page-ID: {first}"] if first is not None else [])
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so that equal records are equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Roll:
    """Files of one task attempt: a new one once the last has roll_bytes compressed bytes."""

    def __init__(self, folder: str, part: int, roll_bytes: int):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.folder, self.part, self.roll_bytes, self.attempt = folder, part, roll_bytes, uuid.uuid4().hex
        self.done: list[tuple] = []
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{len(self.done):06d}.warc.gz"
            self.temp = f"_temporary/{self.attempt}-{self.name}"
            self.store.create_dir(f"{self.base}/_temporary", recursive=True)
            self.out, self.n, self.size, self.sha = self.store.open_output_stream(f"{self.base}/{self.temp}", compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.n, self.size = self.n + 1, self.size + len(data)
        self.sha.update(data)
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.part, len(self.done), self.name, self.temp, self.n, self.size, self.sha.hexdigest()))
            self.out = None


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", part_bytes: int = 32 << 20, roll_bytes: int = 64 << 20, most_parts: int = 8192, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages under folder and returns the manifest (also written as <folder>/manifest).

    Of records with equal payloads of at least least bytes that with the smallest page_id is a response, the others
    revisit it. Null payloads are empty. Null ids come last; rows that share the smallest id (or have none) and the
    payload make one response, the rest of them revisits. An empty table gives an empty manifest. Parts hold about
    part_bytes of records each, or more where that would make over most_parts of them: what the driver holds of their
    splitters is bounded, and a part is a stream that is rolled by size whatever its own.
    """
    spark = pages.sparkSession
    cuts = Cuts(spark, "warc")
    body = F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), body.alias("payload"))
    digest, order = F.sha2("payload", 256), F.coalesce(F.col("page_id"), F.lit(NULL_LAST))
    # ids, sizes and digests: what is needed to tell copies and place records, without the payloads
    facts = cuts.cut(rows.select("page_id", order.alias("a"), digest.alias("digest"), F.octet_length("payload").cast("long").alias("size")))
    copies = facts.where(F.col("size") >= least).groupBy("digest").agg(F.min("a").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    sized = facts.select("a", F.xxhash64("digest").alias("b"), (F.col("size") + 400).alias("size"))
    parts = max(1, min(most_parts, -(-(sized.agg(F.sum("size")).first()[0] or 0) // part_bytes)))
    splits = split(sized, parts, parts, tolerance=0.05, whole=False)
    # A mark per page with copies goes ahead of its payload rows, which so needn't be joined by digest.
    none = F.lit(None)
    marks = facts.join(copies, F.col("digest") == F.col("d")).select("page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", "a", "first", F.lit(0).alias("kind")).distinct()
    known = marks.union(rows.select("page_id", "url", "payload", digest.alias("digest"), order.alias("a"), none.cast("long").alias("first"), F.lit(1).alias("kind")))
    moved = exchange(known, splits, F.col("a"), F.xxhash64("digest"), [F.col("digest"), F.col("kind"), F.col("url").asc_nulls_first()], "part", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark, before = None, (), None
        for b in batches:
            for page_id, url, payload, digest, a, first, kind, part in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "a", "first", "kind", "part")), strict=True):
                if not kind:
                    mark = (a, digest, first)
                    continue
                files = files or Roll(folder, part, roll_bytes)
                first = mark[2] if mark[:2] == (a, digest) else None
                revisit = first is not None and (a != first or before == (a, digest))
                before = (a, digest)
                files.add(member(record(page_id, url, payload, digest, None if first == NULL_LAST else first, revisit, date)))
        if files:
            files.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files.done, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")]).cast(pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temp", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    reported = cuts.cut(moved.mapInArrow(run, MANIFEST))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, temp in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if store.get_file_info(f"{base}/{temp}").type != fs.FileType.NotFound:  # else an earlier attempt has done it
                    store.move(f"{base}/{temp}", f"{base}/{name}")
            yield b

    reported.mapInArrow(rename, MANIFEST).drop("temp").write.parquet(f"{folder}/manifest")
    cuts.drop()
    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{base}/_temporary")
    return spark.read.schema(MANIFEST.replace("temp string, ", "")).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members, a record in memory at a time."""
    buffer, z = b"", zlib.decompressobj(31)
    rest = b""

    def need(n: int) -> bool:
        nonlocal buffer, z, rest
        while len(buffer) < n:
            data = rest or stream.read(1 << 18)
            rest = b""
            if not data:
                return False
            buffer += z.decompress(data)
            if z.eof:
                rest, z = z.unused_data, zlib.decompressobj(31)
        return True

    while need(1):
        size = 1 << 10
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not need(size):
                raise ValueError("a record's headers have no end")
            size = max(size, len(buffer)) + 1
        head = dict(x.split(": ", 1) for x in buffer[:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        if not need(end + 8 + n):
            raise ValueError("a record is cut short")
        yield head, buffer[end + 4 : end + 4 + n]
        buffer = buffer[end + 8 + n :]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the records that folder's manifest names.

    Files, blocks and payloads are held against their digests; payload is null for revisits.
    """
    files = spark.read.parquet(f"{folder}/manifest")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            for name, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out, held, n = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        n += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:") or kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: {head['WARC-Record-ID']} doesn't match its digest")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        whole = lambda key, head=head: int(head[key]) if key in head else None
                        out.append((whole("X-Page-ID"), head["WARC-Target-URI"], kind, size, digest, whole("X-Refers-To-Page-ID"), payload if kind == "response" else None))
                        held += len(payload)
                        if held > 8 << 20 or len(out) >= 10_000:
                            yield batch(out)
                            out, held = [], 0
                if n != count:
                    raise ValueError(f"{name}: {n} records, the manifest has {count}")
                if out:
                    yield batch(out)

    return files.select("name", "n_records").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives written of pages."""
    folder = folder or new_path(pages.sparkSession, "archive")
    write_warc(pages, folder, **how)
    return read_warc(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
