"""From segments back to postings, residual codes, and sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.columns import PARAMETERS, bit_width, line, unzigzag, words_bytes, zigzag


def residuals(segments: DataFrame) -> DataFrame:
    """(list_id, block_id, first, pos, residual) and the segment's parameters."""
    return segments.select("list_id", "block_id", "epsilon", "first", *PARAMETERS, F.posexplode("residuals").alias("k", "residual")).withColumn("pos", F.col("first") + F.col("k")).drop("k")


def decode(segments: DataFrame) -> DataFrame:
    """(list_id, pos, doc_id): the line plus the residual."""
    return residuals(segments).select("list_id", "pos", (line() + F.col("residual")).alias("doc_id"))


def delta_codes(segments: DataFrame) -> DataFrame:
    """residuals with delta (the first of a segment is the residual itself) and its zigzag code."""
    w = Window.partitionBy("list_id", "block_id", "first").orderBy("pos")
    rows = residuals(segments).withColumn("delta", F.col("residual") - F.coalesce(F.lag("residual").over(w), F.lit(0)))
    return rows.withColumn("code", zigzag(F.col("delta")))


def decode_codes(codes: DataFrame) -> DataFrame:
    """(list_id, pos, doc_id) of delta_codes: running sums of the codes in each segment."""
    w = Window.partitionBy("list_id", "block_id", "first").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return codes.withColumn("r", F.sum(unzigzag(F.col("code"))).over(w)).select("list_id", "pos", (line() + F.col("r")).cast("bigint").alias("doc_id"))


def index_sizes(segments: DataFrame, variant: str = "none") -> DataFrame:
    """Per block: keys, segments, parameter widths and bytes. For variant pfor the residual bytes are a bit-width model of the codes, not a codec's output."""
    out = segments.groupBy("list_id", "block_id").agg(F.max("epsilon").alias("epsilon"), F.sum("covered").cast("bigint").alias("n"), F.count("*").alias("n_segments"), *[bit_width(F.max(p)).alias(f"w_{p}") for p in PARAMETERS])
    seg = sum((words_bytes(F.col("n_segments"), F.col(f"w_{p}")) for p in PARAMETERS[1:]), words_bytes(F.col("n_segments"), F.col("w_covered"))) + 1
    out = out.withColumn("segment_bytes", seg.cast("bigint"))
    if variant == "none":
        return out.withColumns({"correction_bytes": words_bytes(F.col("n"), bit_width(F.col("epsilon"))), "sign_bytes": F.expr("n div 8")}).withColumn("total_bytes", F.expr("segment_bytes + correction_bytes + sign_bytes"))
    bits = delta_codes(segments).groupBy("list_id", "block_id").agg(F.sum(bit_width(F.col("code"))).alias("bits"))
    return out.join(bits, ["list_id", "block_id"]).withColumns({"correction_bytes": (F.ceil(F.col("bits") / 32) * 4).cast("bigint"), "sign_bytes": F.lit(0).cast("bigint")}).drop("bits").withColumn("total_bytes", F.expr("segment_bytes + correction_bytes"))


def list_sizes(sizes: DataFrame) -> DataFrame:
    """Per list: n, segments, bytes and bits per key."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("n", "n_segments", "segment_bytes", "correction_bytes", "sign_bytes", "total_bytes")]
    return sizes.groupBy("list_id").agg(*sums).withColumn("bits_per_int", F.col("total_bytes") / F.col("n") * 8)


def index_stats(sizes: DataFrame) -> DataFrame:
    """The whole index in one row; the ratio is to 4 bytes a key."""
    one = list_sizes(sizes).agg(F.count("*").alias("n_lists"), *[F.sum(c).cast("bigint").alias(c) for c in ("n", "n_segments", "segment_bytes", "correction_bytes", "sign_bytes", "total_bytes")])
    return one.withColumns({"avg_covered": F.col("n") / F.col("n_segments"), "avg_segments": F.col("n_segments") / F.col("n_lists"), "compression_ratio": F.col("total_bytes") / (F.col("n") * 4), "gib": F.col("total_bytes") / F.lit(float(1 << 30)), "bytes_per_int": F.col("total_bytes") / F.col("n")})


def sample_residuals(segments: DataFrame, lists: int = 8, seed: int = 0) -> DataFrame:
    """(list_id, block_id, first, pos, residual, delta, code) of some lists, the first in a seeded order of MD5 hashes."""
    some = segments.select("list_id").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), "list_id")), "list_id").limit(lists)
    return delta_codes(segments.join(F.broadcast(some), "list_id", "left_semi")).select("list_id", "block_id", "first", "pos", "residual", "delta", "code")


def plain_sizes(sizes: DataFrame) -> DataFrame:
    """index_sizes with plain_bytes: 20 bytes a segment, unpacked, and 1 a block, beside corrections and signs."""
    return sizes.withColumn("plain_bytes", F.expr("n_segments * 20 + 1 + correction_bytes + sign_bytes"))


def max_slopes(segments: DataFrame) -> DataFrame:
    """(list_id, max_slope): the steepest line's slope among a list's segments."""
    return segments.groupBy("list_id").agg(F.max(F.col("delta_y") / F.col("delta_x")).alias("max_slope"))
