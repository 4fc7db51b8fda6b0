"""Mixing overlapping sources to target weights by min-cost flow, then seeded selection of documents."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Cuts, col

BITS, LEVEL = 60, 12  #: of the seeded order, and how many each pass resolves
MORE = "array<struct<start: long, end: long, most: long>>"


def capped_targets(sizes: list[int], weights: list[int], share: Fraction, cap: int) -> list[Fraction]:
    """share times all sizes, dealt by weight; none over cap times its size, the excess dealt again by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(cap * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def min_cost_flow(capacity: dict[tuple, list[tuple[int, int]]], quota: dict, members: dict[tuple, list]) -> dict[tuple, int]:
    """Tokens of each pattern that reach quotas, at the least cost.

    capacity: per pattern, (tokens, cost per token) in order of cost, one entry for each repetition. members: the
    sources of each pattern. Successive shortest paths with potentials over whole numbers.
    """
    nodes = {"s": 0, "t": 1}
    for n in [*(("p", p) for p in capacity), *(("q", q) for q in quota)]:
        nodes[n] = len(nodes)
    graph: list[list[int]] = [[] for _ in nodes]
    to, room, cost = [], [], []

    def arc(u: int, v: int, c: int, w: int) -> None:
        for x, y, z, k in ((u, v, c, w), (v, u, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(z)
            cost.append(k)

    first: dict[tuple, list[int]] = {}
    for p, steps in capacity.items():
        first[p] = []
        for c, w in steps:
            first[p].append(len(to))
            arc(0, nodes["p", p], c, w)
        for q in members[p]:
            arc(nodes["p", p], nodes["q", q], sum(c for c, _ in steps), 0)
    for q, n in quota.items():
        arc(nodes["q", q], 1, n, 0)
    high = [0] * len(nodes)
    while True:
        dist, via = {0: 0}, {}
        heap = [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if room[e] and (n := d + cost[e] + high[u] - high[to[e]]) < dist.get(to[e], n + 1):
                    dist[to[e]], via[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if 1 not in dist:
            break
        for u, d in dist.items():
            high[u] += d
        v, path = 1, []
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return {p: sum(room[e ^ 1] for e in arcs) for p, arcs in first.items()}


def _facts(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with the columns __size (words), __p (sorted set of sources) and __h (place in the seeded order)."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    several = dict(docs.dtypes)[source_col].startswith("array")
    sources = F.array_sort(F.array_distinct(col(source_col).cast("array<string>"))) if several else F.array(col(source_col).cast("string"))
    unknown = F.array(F.lit(None).cast("string"))
    return docs.withColumns({
        "__size": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"),
        "__p": F.when(F.size(sources) > 0, sources).otherwise(unknown),
        "__h": F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(id_col).cast("long"), text), 64 - BITS),
    })


def prefixes(facts: DataFrame, wanted: dict[tuple, tuple[int, int]]) -> dict[tuple, tuple[int, int]]:
    """For patterns with (start, left): of their documents from place start on and of at most left words, the longest prefix in the seeded order that has at most left words; (place behind it, its words).

    Places have BITS bits, of which each pass over facts resolves LEVEL.
    """
    spark = facts.sparkSession
    mark, taken = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0)
    open_, done = set(wanted), 0
    while open_ and done < BITS:
        step = min(LEVEL, BITS - done)
        rows = spark.createDataFrame([(list(p), mark[p] >> (BITS - done), *wanted[p]) for p in sorted(open_, key=repr)], "q array<string>, x long, start long, most long")
        bucket = F.shiftrightunsigned("__h", BITS - done - step).bitwiseAND((1 << step) - 1)
        near = facts.join(F.broadcast(rows), F.col("__p").eqNullSafe(F.col("q")) & (F.col("x") == F.shiftrightunsigned("__h", BITS - done))).where("__h >= start and __size <= most")
        part: dict[tuple, dict[int, tuple]] = {}
        for r in near.groupBy("q", bucket.alias("b")).agg(F.sum("__size").alias("s"), F.count("*").alias("n")).collect():
            part.setdefault(tuple(r.q), {})[r.b] = (r.s, r.n)
        done += step
        unit = BITS - done
        for p in list(open_):
            above = mark[p] >> unit >> step << step
            for b, (s, n) in sorted(part.get(p, {}).items()):
                if taken[p] + s > wanted[p][1]:
                    mark[p] = (above + b) << unit
                    if n == 1 or not unit:
                        open_.discard(p)
                    break
                taken[p] += s
            else:
                mark[p] = 1 << BITS
                open_.discard(p)
    return {p: (mark[p], taken[p]) for p in wanted}


def plan(facts: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: str = "1.5", repeats: int = 2, max_patterns: int = 100_000, near: float = 0.001, rounds: int = 8) -> DataFrame:
    """(q, base, source_size, target, more) for each pattern q of facts: base copies of all its documents, and one more of those that more admits.

    more lists (start, end, most): places from start up to end, of documents of at most most words. In each of the rounds
    the documents that would pass the quota are passed over, and smaller ones behind them fill what is left, until that is
    near times the quota. The driver holds patterns alone; they are counted first, and over max_patterns is an error.
    """
    spark = facts.sparkSession
    found = facts.groupBy("__p").agg(F.sum("__size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"over {max_patterns} patterns of sources")
    whole = {tuple(r[0]): r.size for r in found}
    names = sorted({s for p in whole for s in p}, key=lambda s: (s is None, s or ""))
    held = {s: sum(n for p, n in whole.items() if s in p) for s in names}
    target = dict(zip(names, capped_targets([held[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], Fraction(share), repeats), strict=True))
    flow = min_cost_flow({p: [(n, k) for k in range(repeats)] for p, n in whole.items()}, {s: round(t) for s, t in target.items()}, {p: list(p) for p in whole})
    base = {p: (f // whole[p] if whole[p] else 0) for p, f in flow.items()}
    left = {p: f - base[p] * whole[p] for p, f in flow.items()}
    start = dict.fromkeys(whole, 0)
    more: dict[tuple, list[tuple[int, int, int]]] = {p: [] for p in whole}
    for _ in range(rounds):
        open_ = {p: (start[p], left[p]) for p in whole if left[p] > near * flow[p] and start[p] < 1 << BITS}
        if not open_:
            break
        for p, (end, words) in prefixes(facts, open_).items():
            more[p].append((start[p], end, left[p]))
            start[p], left[p] = end, left[p] - words
    # Where much is still left, the smallest document that is left too, if it passes the quota by less than is left.
    coarse = [(list(p), more[p], left[p]) for p in whole if left[p] > 10 * near * flow[p]]
    if coarse:
        rest = facts.join(F.broadcast(spark.createDataFrame(coarse, f"q array<string>, more {MORE}, left long")), F.col("__p").eqNullSafe(F.col("q")))
        for r in rest.where(~admitted() & (F.col("__size") < 2 * F.col("left"))).groupBy("q").agg(F.min(F.struct("__size", "__h")).alias("x")).collect():
            more[tuple(r.q)].append((r.x[1], r.x[1] + 1, r.x[0]))
    rows = [(list(p), base[p], sum(held[s] for s in p), float(sum(target[s] for s in p)), more[p]) for p in whole]
    return spark.createDataFrame(rows, "q array<string>, base long, source_size long, target double, more " + MORE)


def admitted() -> Column:
    """Whether a document of facts is among more."""
    return F.exists("more", lambda m: (F.col("__h") >= m["start"]) & (F.col("__h") < m["end"]) & (F.col("__size") <= m["most"]))


def copies() -> Column:
    """Of facts joined with their plan."""
    return F.col("base") + F.when(admitted(), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs; source_col may also hold an array of sources.

    size is the number of words of the whole text (null: 0). Sources in order of code points, null last, have the
    weights in turn; targets are share times all sizes dealt by weight, at most repeats times the source's size.
    Documents with the same set of sources make a pattern (none: that of the null source); a min-cost flow routes the
    patterns' words to the quotas, the n-th copy of a word at cost n - 1. A pattern's whole copies go to all its
    documents, the rest to those that come first in a seeded order of (doc_id, text) and still fit the quota (see plan). source_size and target of a document with several sources are sums over them. Rows that are wholly equal
    share their place in the order. An empty table gives an empty result.
    """
    cuts = Cuts(docs.sparkSession, "mix")
    facts = _facts(docs, id_col, text_col, source_col, seed)
    facts = cuts.cut(facts.select(col(id_col).cast("long").alias("doc_id"), "__size", "__p", "__h"))
    known = plan(facts, **how)
    joined = facts.join(F.broadcast(known), F.col("__p").eqNullSafe(F.col("q")))
    return joined.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * copies()).alias("taken"), copies().alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **how) -> DataFrame:
    """docs as the mix takes them: each row as many times as it has copies (see mix), with the columns of docs."""
    cuts = Cuts(docs.sparkSession, "mixed")
    facts = _facts(docs, id_col, text_col, source_col, seed)
    known = plan(cuts.cut(facts.select("__size", "__p", "__h")), **how).select("q", "base", "more")
    joined = facts.join(F.broadcast(known), F.col("__p").eqNullSafe(F.col("q")))
    return joined.select(*[col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies().cast("int"))).alias("__copy")).drop("__copy")
