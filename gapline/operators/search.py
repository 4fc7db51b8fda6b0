"""AND, OR, ANDNOT and next-greater-or-equal over posting lists, in several strategies with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.columns import PARAMETERS, line
from gapline.operators.gaps import BLOCK
from gapline.operators.stats import RANGE_BITS, pages, with_page

BITMAP_BITS = 32768


def clean_terms(queries: DataFrame) -> DataFrame:
    """queries(query_id, terms) with sorted distinct terms and their number k."""
    return queries.select("query_id", F.array_sort(F.array_distinct("terms")).alias("terms")).withColumn("k", F.size("terms").cast("bigint"))


def valid_queries(queries: DataFrame, least: int = 2) -> DataFrame:
    return clean_terms(queries).where(F.col("k") >= least)


def _terms(queries: DataFrame) -> DataFrame:
    return clean_terms(queries).select("query_id", "k", F.explode("terms").alias("list_id"))


def matches(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, k, doc_id, c): in how many of a query's lists a document is; sums combine before the exchange."""
    return postings.select("list_id", "doc_id").join(_terms(queries), "list_id").groupBy("query_id", "k", "doc_id").agg(F.count("*").alias("c"))


def and_query(postings: DataFrame, queries: DataFrame) -> DataFrame:
    return matches(postings, queries).where("c = k").select("query_id", "doc_id")


def or_query(postings: DataFrame, queries: DataFrame) -> DataFrame:
    return matches(postings, queries).select("query_id", "doc_id")


def and_not(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents of a query's first term's list that are in none of the others'."""
    t = queries.select("query_id", F.posexplode("terms").alias("i", "list_id"))
    hit = postings.select("list_id", "doc_id").join(t, "list_id").groupBy("query_id", "doc_id").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    return hit.where("a = 0 and b = 0").select("query_id", "doc_id")


def and_semi(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """AND as a chain of semi joins from each query's first term."""
    ks = [r.k for r in clean_terms(queries).select("k").distinct().limit(1000).collect()]
    q = clean_terms(queries)
    p = postings.select("list_id", "doc_id")
    out = None
    for i in range(max(ks, default=0)):
        here = q.where(F.col("k") > i).select("query_id", F.element_at("terms", i + 1).alias("list_id"))
        docs = p.join(here, "list_id").select("query_id", "doc_id")
        out = docs if out is None else out.join(q.where(F.col("k") > i).select("query_id"), "query_id", "left_semi").join(docs, ["query_id", "doc_id"], "left_semi").union(out.join(q.where(F.col("k") <= i).select("query_id"), "query_id", "left_semi"))
    return out if out is not None else p.select(F.col("list_id").alias("query_id"), "doc_id").limit(0)


def _ranges(postings: DataFrame) -> DataFrame:
    """Each list's ids as sorted arrays by range of BITMAP_BITS ids: arrays have a bounded length."""
    return postings.groupBy("list_id", F.expr(f"doc_id div {BITMAP_BITS}").alias("r")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))


def by_arrays(postings: DataFrame, queries: DataFrame, op: str) -> DataFrame:
    """AND or OR by intersecting or uniting arrays, range by range, the shortest first."""
    got = _ranges(postings).join(_terms(queries), "list_id").groupBy("query_id", "k", "r").agg(F.collect_list(F.struct(F.size("ids").alias("n"), "list_id", "ids")).alias("ls"))
    got = got.withColumn("ls", F.transform(F.array_sort("ls"), lambda x: x["ids"]))
    if op == "and":
        both = F.aggregate(F.slice("ls", 2, F.size("ls")), F.element_at("ls", 1), lambda a, b: F.array_intersect(a, b))
        got = got.where(F.size("ls") == F.col("k")).withColumn("ids", both)
    else:
        got = got.withColumn("ids", F.array_distinct(F.flatten("ls")))
    return got.select("query_id", F.explode("ids").alias("doc_id"))


def bitmap_counts(postings: DataFrame, queries: DataFrame, op: str) -> DataFrame:
    """(query_id, n) by bitmaps; a query without a result has no row."""
    at = F.col("doc_id") + 1
    maps = postings.groupBy("list_id", F.bitmap_bucket_number(at).alias("r")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b"))
    got = maps.join(_terms(queries), "list_id").groupBy("query_id", "k", "r")
    got = got.agg(F.bitmap_and_agg("b").alias("b"), F.count("*").alias("c")).where("c = k") if op == "and" else got.agg(F.bitmap_or_agg("b").alias("b"))
    return got.groupBy("query_id").agg(F.sum(F.bitmap_count("b")).cast("bigint").alias("n")).where("n > 0")


def counts(result: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n) for every query, 0 included."""
    n = result.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


def load_stats(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_lists, total_size, avg_size) of the lists that queries load."""
    lists = postings.groupBy("list_id").agg(F.count("*").alias("n"))
    return lists.join(_terms(queries), "list_id").groupBy("query_id").agg(F.count("*").alias("n_lists"), F.sum("n").cast("bigint").alias("total_size"), F.avg("n").alias("avg_size"))


def _placed(units: DataFrame, probes: DataFrame) -> DataFrame:
    """(list_id, x, unit): of units(list_id, unit, last), in order of last, the list's first with last >= x; null if none.

    Units and probes meet by ranges of 2 ** RANGE_BITS ids; what a range lacks comes from the next range that has a unit.
    """
    both = units.select("list_id", F.col("last").alias("at"), "unit", F.lit(1).alias("kind")).union(probes.select("list_id", F.col("x"), F.lit(None).cast("bigint"), F.lit(0)))
    both = both.withColumn("r", F.expr(f"shiftright(at, {RANGE_BITS})"))
    # from the end: a growing frame costs a step a row, one that shrinks would be scanned anew for every row
    ahead = Window.partitionBy("list_id", "r").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("list_id").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    heads = both.groupBy("list_id", "r").agg(F.min("unit").alias("head")).select("list_id", "r", F.last("head", ignorenulls=True).over(later).alias("beyond"))
    placed = both.withColumn("unit", F.last("unit", ignorenulls=True).over(ahead)).where("kind = 0").join(heads, ["list_id", "r"])
    return placed.select("list_id", F.col("at").alias("x"), F.coalesce("unit", "beyond").alias("unit"))


def next_geq(keyed: DataFrame, probes: DataFrame) -> DataFrame:
    """(list_id, x, doc_id): the list's smallest id >= x, null if none, for distinct probes(list_id, x).

    The pages' last ids are the skip table: a probe finds its page there, and then its id among that page's.
    """
    p = probes.select("list_id", "x").distinct()
    placed = _placed(pages(keyed).select("list_id", F.col("page").alias("unit"), F.col("last_id").alias("last")), p)
    found = placed.withColumnRenamed("unit", "page").join(with_page(keyed), ["list_id", "page"]).where("doc_id >= x").groupBy("list_id", "x").agg(F.min("doc_id").alias("doc_id"))
    return p.join(found, ["list_id", "x"], "left").select("list_id", "x", "doc_id")


def seek_segments(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """(list_id, x, doc_id, n_skipped): next_geq on stored segments, and how many keys stand in the segments before.

    The segments' last values are the skip table. In the one segment a probe comes to, the line tells which keys can be
    the answer: those where it passes x by epsilon at most. Only their residuals are looked at; nothing else is decoded.
    """
    p = probes.select("list_id", "x").distinct()
    placed = _placed(segments.select("list_id", F.col("first").alias("unit"), F.col("last_value").alias("last")), p)
    hit = placed.where("unit is not null").join(segments.drop("block_id", "first_value", "last_value").withColumnRenamed("first", "unit"), ["list_id", "unit"])
    # the line is within epsilon + 1 of x from position `from` (of the segment) on, and past it by that from `to` on
    reach = "floor((x - y_b {} (epsilon + 1)) * delta_x / delta_y) + x_b - unit"
    hit = hit.withColumns({
        "from": F.expr(f"case when delta_y = 0 then 0 else least(greatest({reach.format('-')} - 1, 0), covered - 1) end").cast("int"),
        "to": F.expr(f"case when delta_y = 0 then covered - 1 else least(greatest({reach.format('+')} + 2, 0), covered - 1) end").cast("int"),
    })
    near = F.transform(F.slice("residuals", F.col("from") + 1, F.col("to") - F.col("from") + 1), lambda r, k: F.struct(F.col("unit") + F.col("from") + k, r))
    hit = hit.select("list_id", "x", "unit", *PARAMETERS, F.inline(near).alias("pos", "r")).select("list_id", "x", "unit", (line() + F.col("r")).alias("doc_id"))
    found = hit.where("doc_id >= x").groupBy("list_id", "x").agg(F.min("doc_id").alias("doc_id"), F.min("unit").alias("n_skipped"))
    return p.join(found, ["list_id", "x"], "left").select("list_id", "x", "doc_id", "n_skipped")


def seek_gaps(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """(list_id, x, doc_id, n_skipped): next_geq on the baseline's blocks: their maxima are the skip table, and one block is decoded for a probe."""
    p = probes.select("list_id", "x").distinct()
    placed = _placed(blocks.select("list_id", F.col("block_no").alias("unit"), F.col("block_max").alias("last")), p)
    hit = placed.join(blocks.select("list_id", F.col("block_no").alias("unit"), "block_max", "gaps"), ["list_id", "unit"])
    # from the block's end: the last key, and the least key so far that is at least x
    start = F.struct(F.col("block_max").alias("key"), F.col("block_max").alias("best"))
    step = lambda acc, gap: F.struct((acc["key"] - gap - 1).alias("key"), F.when(acc["key"] >= F.col("x"), acc["key"]).otherwise(acc["best"]).alias("best"))
    found = hit.select("list_id", "x", F.aggregate(F.reverse("gaps"), start, step, lambda acc: acc["best"]).alias("doc_id"), (F.col("unit") * BLOCK).alias("n_skipped"))
    return p.join(found, ["list_id", "x"], "left").select("list_id", "x", "doc_id", "n_skipped")


def cursor(keyed: DataFrame) -> DataFrame:
    """(list_id, doc_id, next_id): null at the list's end; page by page, with the next page's first id."""
    first = pages(keyed).select("list_id", (F.col("page") - 1).alias("page"), F.col("first_id").alias("beyond"))
    rows = with_page(keyed).join(first, ["list_id", "page"], "left")
    return rows.select("list_id", "doc_id", F.coalesce(F.lead("doc_id").over(Window.partitionBy("list_id", "page").orderBy("pos")), "beyond").alias("next_id"))


def skip_rate(sought: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: keys in the probed lists of sizes(list_id, n), those that the probes of sought(list_id, n_skipped) skip, and their share."""
    skips = sought.where("n_skipped is not null").groupBy("list_id").agg(F.sum("n_skipped").alias("n_skipped"), F.count("*").alias("n_probes"))
    one = skips.join(sizes, "list_id").agg(F.sum(F.col("n") * F.col("n_probes")).cast("bigint").alias("n"), F.sum("n_skipped").cast("bigint").alias("n_skipped"))
    return one.withColumn("rate", F.col("n_skipped") / F.col("n"))
