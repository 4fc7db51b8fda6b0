"""Residual codes as bytes: patched frames. A frame's codes are packed at the width that makes it smallest; codes that are wider
keep their low bits in place, and their places and high bits follow as exceptions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 256  #: codes of a frame; the last may have fewer
HEAD = "<BBB"  #: a frame's width, its exceptions, and the width of their high bits
ENCODED = "list_id bigint, block_id bigint, first bigint, covered bigint, delta_y bigint, delta_x bigint, y_b bigint, x_b bigint, epsilon bigint, codes binary"


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of width bits each, low bits first, in whole bytes."""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return (bits.astype(np.int64) << np.arange(width)).sum(1)


def size(n: int, width: int) -> int:
    return (n * width + 7) // 8


def encode(codes: np.ndarray) -> bytes:
    """codes, whole numbers from 0 to 2 ** 62, as frames."""
    out = []
    for k in range(0, len(codes), FRAME):
        c = codes[k : k + FRAME]
        bits = np.frexp(c.astype(float))[1] if c.max(initial=0) < 1 << 52 else np.array([int(x).bit_length() for x in c])
        most = int(bits.max())
        over = np.cumsum(np.bincount(bits, minlength=most + 1)[::-1])[::-1]  # codes of at least so many bits
        wider = np.r_[over[1:], 0]  # exceptions at each width
        allowed = [w for w in range(most + 1) if wider[w] < FRAME]
        width = min(allowed, key=lambda w: (size(len(c), w) + (int(wider[w]) + size(int(wider[w]), most - w) if wider[w] else 0), w))
        at = np.flatnonzero(bits > width)
        high = most - width if len(at) else 0
        out.append(struct.pack(HEAD, width, len(at), high) + pack(c & ((1 << width) - 1), width) + at.astype(np.uint8).tobytes() + pack(c[at] >> width, high))
    return b"".join(out)


def decode(data: bytes, n: int) -> np.ndarray:
    """n codes of encode's frames."""
    view, at, out = memoryview(data), 0, []
    for k in range(0, n, FRAME):
        m = min(FRAME, n - k)
        width, extra, high = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        c = unpack(view[at : at + size(m, width)], m, width)
        at += size(m, width)
        where = np.frombuffer(view[at : at + extra], np.uint8)
        at += extra
        c[where] |= unpack(view[at : at + size(extra, high)], extra, high) << width
        at += size(extra, high)
        out.append(c)
    if at != len(data):
        raise ValueError("bytes are left over, or lacking")
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def compress(segments: DataFrame) -> DataFrame:
    """segments with codes, the zigzag codes of their residuals' differences as bytes, instead of residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r in b.column(b.num_columns - 1):
                d = np.diff(r.values.to_numpy(zero_copy_only=False), prepend=0)
                made.append(encode((d << 1) ^ (d >> 63)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], [x.split()[0] for x in ENCODED.split(", ")])

    names = [x.split()[0] for x in ENCODED.split(", ")][:-1]
    return segments.select(*names, "residuals").mapInArrow(run, ENCODED)


def expand(encoded: DataFrame) -> DataFrame:
    """Segments, less first_value and last_value, of compress's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for data, n in zip(b.column(b.num_columns - 1).to_pylist(), b.column(3).to_pylist(), strict=True):
                u = decode(data, n)
                made.append(np.cumsum((u >> 1) ^ -(u & 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.list_(pa.int64()))], [*b.schema.names[:-1], "residuals"])

    return encoded.mapInArrow(run, ENCODED.replace("codes binary", "residuals array<bigint>"))


def bytes_of(encoded: DataFrame) -> DataFrame:
    """(list_id, block_id, n, code_bytes): what the codes of each block take."""
    return encoded.groupBy("list_id", "block_id").agg(F.sum("covered").alias("n"), F.sum(F.octet_length("codes")).alias("code_bytes"))
