"""Positions, pages, gaps and their statistics. No window runs over a whole list: units are pages or ranges of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.columns import SCALE, best_epsilon, bit_cost, gap_variance

PAGE = 1024  #: keys of a page
RANGE_BITS = 20  #: of ids that one task numbers together


def positions(postings: DataFrame) -> DataFrame:
    """(list_id, pos, doc_id) of distinct postings(list_id, doc_id): pos counts from 0 in order of doc_id.

    A list is numbered in ranges of 2 ** RANGE_BITS ids, so a list that holds most of all rows is many units.
    """
    rows = postings.select(F.col("list_id").cast("bigint"), F.col("doc_id").cast("bigint"), F.expr(f"shiftright(cast(doc_id as bigint), {RANGE_BITS})").alias("r"))
    counts = rows.groupBy("list_id", "r").count()
    before = F.sum("count").over(Window.partitionBy("list_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("list_id", "r", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("list_id", "r").orderBy("doc_id")) - 1)
    return numbered.join(offsets, ["list_id", "r"]).select("list_id", (F.col("offset") + F.col("k")).cast("bigint").alias("pos"), "doc_id")


def with_page(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("page", F.expr(f"pos div {PAGE}"))


def pages(keyed: DataFrame) -> DataFrame:
    """(list_id, page, n, first_id, last_id, n_gaps, sum_gap, sum_gap2): a page's first key has no gap in it."""
    w = Window.partitionBy("list_id", "page").orderBy("pos")
    gaps = with_page(keyed).withColumn("gap", F.col("doc_id") - F.lag("doc_id").over(w))
    return gaps.groupBy("list_id", "page").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("gap").alias("n_gaps"),
        F.coalesce(F.sum("gap"), F.lit(0)).cast("bigint").alias("sum_gap"), F.coalesce(F.sum((F.col("gap") * F.col("gap")).cast("decimal(38,0)")), F.lit(0)).alias("sum_gap2"),
    )


def page_model(page_table: DataFrame, variant: str = "none") -> DataFrame:
    """page_table with variance, the preferred epsilon and the estimated cost in bits."""
    s, v = SCALE[variant], F.col("variance")
    out = page_table.withColumn("variance", gap_variance(F.col("n_gaps"), F.col("sum_gap"), F.col("sum_gap2")))
    return out.withColumns({"epsilon": best_epsilon(F.col("n"), v, s), "cost": bit_cost(F.col("n"), v, s)})


def page_extremes(page_table: DataFrame) -> DataFrame:
    """(list_id, n_pages, max_var, min_var) over pages that have a gap."""
    model = page_model(page_table)
    some = F.when(F.col("n_gaps") > 0, F.col("variance"))
    return model.groupBy("list_id").agg(F.count("*").alias("n_pages"), F.max(some).alias("max_var"), F.min(some).alias("min_var"))


def list_gaps(keyed: DataFrame) -> DataFrame:
    """keyed with gap (null for a list's first key), across pages."""
    last = pages(keyed).select("list_id", (F.col("page") + 1).alias("page"), F.col("last_id").alias("prev"))
    rows = with_page(keyed).join(last, ["list_id", "page"], "left")
    before = F.lag("doc_id").over(Window.partitionBy("list_id", "page").orderBy("pos"))
    return rows.withColumn("gap", F.col("doc_id") - F.coalesce(before, F.col("prev"))).drop("prev")


def gap_prefix(keyed: DataFrame) -> DataFrame:
    """(list_id, pos, gap, sum_gap, sum_gap2): running sums from the list's first key, by page totals and sums in a page."""
    g = list_gaps(keyed).withColumn("gap2", (F.col("gap") * F.col("gap")).cast("decimal(38,0)"))
    run = Window.partitionBy("list_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = g.groupBy("list_id", "page").agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("t"), F.coalesce(F.sum("gap2"), F.lit(0)).alias("t2"))
    ahead = Window.partitionBy("list_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("list_id", "page", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("b"), F.coalesce(F.sum("t2").over(ahead), F.lit(0)).alias("b2"))
    sums = g.withColumns({"s": F.coalesce(F.sum("gap").over(run), F.lit(0)), "s2": F.coalesce(F.sum("gap2").over(run), F.lit(0))})
    return sums.join(base, ["list_id", "page"]).select("list_id", "pos", "gap", (F.col("b") + F.col("s")).cast("bigint").alias("sum_gap"), (F.col("b2") + F.col("s2")).cast("bigint").alias("sum_gap2"))


def list_stats(keyed: DataFrame) -> DataFrame:
    """(list_id, n, min_id, max_id, mean_gap, var_pop): the last two null for a list of one key."""
    g = list_gaps(keyed).withColumn("gap2", (F.col("gap") * F.col("gap")).cast("decimal(38,0)"))
    out = g.groupBy("list_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.sum("gap2").alias("q"))
    m, s = (F.col("n") - 1).cast("decimal(18,0)"), (F.col("max_id") - F.col("min_id")).cast("decimal(18,0)")
    var = (m * F.col("q").cast("decimal(20,0)") - s * s).cast("double") / (m.cast("double") * m.cast("double"))
    some = F.col("n") > 1
    return out.select("list_id", "n", "min_id", "max_id", F.when(some, s.cast("double") / m.cast("double")).alias("mean_gap"), F.when(some, var).alias("var_pop"))
