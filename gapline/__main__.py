"""Programs over collection files: python -m gapline build | verify | decode | query. Each prints one JSON line."""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import codec, gaps, search, validate
from gapline.plans.index import build
from gapline.sources import collections, store

TABLE = {"segments": "first", "gap128": "block_no"}


def session() -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return spark


def decoded(spark: SparkSession, index: str, kind: str, lists: DataFrame | None = None) -> DataFrame:
    table = store.load(spark, index, lists, kind)
    return codec.decode(table) if kind == "segments" else gaps.decode(table)


def timed(df: DataFrame, repeat: int) -> list[float]:
    """Seconds of each of repeat runs, after one that isn't timed."""
    out = []
    for n in range(repeat + 1):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        if n:
            out.append(time.perf_counter() - t)
    return out


def run_build(spark: SparkSession, a: argparse.Namespace) -> dict:
    keyed, meta = collections.read_docs(spark, a.collection), collections.read_meta(spark, a.collection)
    bad = validate.violations(keyed, meta).select("list_id", "rule").union(validate.empty_lists(keyed, meta).select("list_id", F.lit("empty"))).limit(5).collect()
    if bad:
        raise ValueError(f"the collection breaks rules, as in {[tuple(r) for r in bad]}")
    t = time.perf_counter()
    table = build(keyed, a.epsilon, a.variant, a.blocks, a.method) if a.kind == "segments" else gaps.encode(keyed)
    store.save(table, a.index, extra={"collection": meta}, name=a.kind, order=TABLE[a.kind])
    took = time.perf_counter() - t
    return {"seconds": round(took, 3)} | run_verify(spark, a)


def run_verify(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Sizes of the stored index, and how many postings it doesn't give back."""
    table = store.load(spark, a.index, name=a.kind)
    sizes = codec.index_sizes(table, a.variant) if a.kind == "segments" else None
    unequal = validate.mismatches(collections.read_docs(spark, a.collection), decoded(spark, a.index, a.kind)).agg(F.sum("n_unequal")).first()[0] or 0
    if a.log and sizes is not None:
        codec.list_sizes(sizes).write.mode("overwrite").option("header", True).csv(a.log)
    stats = (codec.index_stats(sizes) if sizes is not None else gaps.sizes(table)).first().asDict()
    return stats | {"unequal": unequal}


def run_decode(spark: SparkSession, a: argparse.Namespace) -> dict:
    keys = decoded(spark, a.index, a.kind)
    n, took = keys.count(), timed(keys, a.repeat)
    return {"n": n, "avg_s": statistics.mean(took), "min_s": min(took), "max_s": max(took), "ns_per_int": 1e9 * statistics.mean(took) / max(1, n)}


def run_query(spark: SparkSession, a: argparse.Namespace) -> dict:
    """AND or OR of every line with at least two different terms. A term that the index lacks is an error, as in loading by name."""
    asked = search.valid_queries(collections.read_queries(spark, a.queries))
    lists = asked.select(F.explode("terms").alias("list_id")).distinct()
    lost = store.missing(store.load(spark, a.index, lists, a.kind), lists).limit(5).collect()
    if lost:
        raise ValueError(f"lists that the index lacks, as {[r.list_id for r in lost]}")
    postings = decoded(spark, a.index, a.kind, lists)
    result = (search.and_query if a.op == "AND" else search.or_query)(postings, asked)
    if a.out:
        result.write.mode("overwrite").parquet(a.out)
    load = search.load_stats(postings, asked).agg(F.count("*").alias("q"), F.avg("total_size").alias("s")).first()
    took = timed(result, a.repeat)
    return {"n_queries": load.q, "total_size": result.count(), "avg_list_size": load.s, "avg_s": statistics.mean(took), "median_s": statistics.median(took)}


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="gapline", description=__doc__)
    programs = parser.add_subparsers(dest="program", required=True)
    for name, f in (("build", run_build), ("verify", run_verify), ("decode", run_decode), ("query", run_query)):
        p = programs.add_parser(name)
        p.set_defaults(run=f)
        p.add_argument("index", help="folder of the index")
        p.add_argument("--kind", choices=list(TABLE), default="segments", help="learned segments, or the baseline of gaps in blocks of 128")
        if name in ("build", "verify"):
            p.add_argument("collection", help=".docs file, or a folder of them")
            p.add_argument("--variant", choices=["none", "pfor"], default="none", help="how residuals are coded")
            p.add_argument("--log", help="folder for sizes per list, as CSV")
        if name == "build":
            p.add_argument("--epsilon", type=int, default=0, help="error bound; 0 lets the cost model choose")
            p.add_argument("--blocks", type=int, help="how many blocks wait to be split at most")
            p.add_argument("--method", choices=["greedy", "optimal"], default="greedy")
        if name == "query":
            p.add_argument("queries", help=".queries file")
            p.add_argument("op", choices=["AND", "OR"])
            p.add_argument("--out", help="folder for the results, as Parquet")
        if name in ("decode", "query"):
            p.add_argument("--repeat", type=int, default=1)
    a = parser.parse_args(argv)
    out = a.run(session(), a)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
