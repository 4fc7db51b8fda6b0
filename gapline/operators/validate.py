"""Rules for posting collections, as rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = (1 << 31) - 2


def violations(keyed: DataFrame, meta: DataFrame) -> DataFrame:
    """(list_id, pos, rule) of keyed(list_id, pos, doc_id) as read; meta has universe_size in one row.

    Rules: range (0 <= id < universe, id <= 2**31 - 2), order (strictly increasing by pos), empty (a list id of meta's
    n_lists without keys), magic and truncated are the reader's.
    """
    before = keyed.select("list_id", (F.col("pos") + 1).alias("pos"), F.col("doc_id").alias("before"))
    rows = keyed.join(before, ["list_id", "pos"], "left").join(F.broadcast(meta.select("universe_size").limit(1)))
    wrong = F.array_compact(F.array(F.when((F.col("doc_id") < 0) | (F.col("doc_id") >= F.col("universe_size")) | (F.col("doc_id") > MOST), F.lit("range")), F.when(F.col("before") >= F.col("doc_id"), F.lit("order"))))
    return rows.select("list_id", "pos", F.explode(wrong).alias("rule"))


def empty_lists(keyed: DataFrame, meta: DataFrame) -> DataFrame:
    """(list_id) of the ordinals below meta's n_lists that have no keys."""
    every = meta.limit(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_lists") - 1)).alias("list_id"))
    return every.join(keyed.select("list_id").distinct(), "list_id", "left_anti")


def mismatches(postings: DataFrame, decoded: DataFrame) -> DataFrame:
    """(list_id, n_unequal): postings that a round trip lost or made up, 0 for the others' lists."""
    side = lambda d, n: d.select("list_id", "doc_id", F.lit(n).alias("s"))
    per = side(postings, 1).union(side(decoded, -1)).groupBy("list_id", "doc_id").agg(F.sum("s").alias("s"))
    return per.groupBy("list_id").agg(F.sum(F.abs("s")).cast("bigint").alias("n_unequal"))
