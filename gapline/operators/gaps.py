"""The baseline: gaps of blocks of 128 keys with the blocks' maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.columns import bit_width

BLOCK = 128


def encode(keyed: DataFrame) -> DataFrame:
    """(list_id, block_no, n, block_max, gaps): a gap is the difference to the key before, less 1; before the first key stands -1."""
    rows = keyed.withColumn("block_no", F.expr(f"pos div {BLOCK}"))
    ends = rows.groupBy("list_id", "block_no").agg(F.count("*").alias("n"), F.max("doc_id").alias("block_max"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    before = ends.select("list_id", (F.col("block_no") + 1).alias("block_no"), F.col("block_max").alias("before"))
    joined = ends.join(before, ["list_id", "block_no"], "left").withColumn("all", F.concat(F.array(F.coalesce("before", F.lit(-1).cast("bigint"))), "ids"))
    return joined.select("list_id", "block_no", "n", "block_max", F.transform("ids", lambda x, i: x - F.element_at("all", i + 1) - 1).alias("gaps"))


def decode(blocks: DataFrame) -> DataFrame:
    """(list_id, pos, doc_id): running sums of gap + 1 back from the block's maximum."""
    rows = blocks.select("list_id", "block_no", "block_max", F.posexplode("gaps").alias("k", "gap"))
    after = F.coalesce(F.sum(F.col("gap") + 1).over(Window.partitionBy("list_id", "block_no").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("list_id", (F.col("block_no") * BLOCK + F.col("k")).cast("bigint").alias("pos"), (F.col("block_max") - after).cast("bigint").alias("doc_id"))


def widths(blocks: DataFrame) -> DataFrame:
    """(list_id, block_no, width): bits of the block's largest gap."""
    return blocks.select("list_id", "block_no", bit_width(F.array_max("gaps")).alias("width"))


def sizes(blocks: DataFrame) -> DataFrame:
    """One row: keys, original and packed bytes, percent ratio (original to packed) and bits per key."""
    packed = F.ceil(F.size("gaps") * bit_width(F.array_max("gaps")) / 32) * 4 + 8
    one = blocks.agg(F.sum("n").cast("bigint").alias("n"), F.sum(packed).cast("bigint").alias("packed_bytes"))
    return one.withColumns({"orig_bytes": F.col("n") * 4, "ratio": F.col("n") * 400 / F.col("packed_bytes"), "bpi": F.col("packed_bytes") * 8 / F.col("n")})
