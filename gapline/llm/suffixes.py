"""Exact repeated byte strings by suffix order and longest-previous-factor arrays.

Anchored contexts that may repeat are gathered by anchor into shards of bounded size. Within a shard the suffixes of
the contexts are put in order; previous and next smaller positions in that order give, for each position, the longest
match with an earlier one (the longest previous factor), and the same from the other end the longest match with a
later one. Contexts that occur more than once as a whole (by 128-bit digests of their text) need no sorting: all but one
of each stay out of the shards.
An anchor whose different contexts outgrow a shard has its windows dealt out by 128-bit hashes instead, packed, so that
no anchor, however common, gathers in one task. Among n different contexts or windows the chance that any two have one
digest is below n ** 2 / 2 ** 129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.anchors import Hashes, covered, runs
from gapline.llm.common import Cuts, col, mix, partitions, texts
from gapline.llm.phrases import SALTS, groups, hot_keys

GRAM = 96  #: bytes of an anchor
AT_ONCE = 1 << 19  #: bytes laid end to end at a time, or one document
SHARD = 1 << 20  #: bytes of contexts sorted together, or those of one anchor
PACK = 7  #: symbols that the first sort compares at once
SPREAD = 4 << 20  #: bytes of one anchor's contexts from which its windows are compared by hash, in parts of a quarter of that
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))
OTHER = mix(SYMBOLS)
MARK = np.array([256])
PIECES = "akey long, part int, c long, sha string, start long, n long, context binary, shas array<string>, cs array<long>, windows binary"


PIECE_SCHEMA = pa.schema([("akey", pa.int64()), ("part", pa.int32()), ("c", pa.int64()), ("sha", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("context", pa.binary()), ("shas", pa.list_(pa.string())), ("cs", pa.list_(pa.int64())), ("windows", pa.binary())])


def laid_out(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    return SYMBOLS[np.frombuffer(b"".join(docs), np.uint8)], ends - sizes, ends


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions in order of their next `depth` symbols at least, and the ranks at doubling lengths that led there.

    data: whole numbers from 0 to 510. Ranks of equal prefixes are equal; the end comes before every symbol.
    """
    n = len(data)
    packed = np.zeros(n, np.int64)  # PACK symbols of 9 bits each
    for k in range(PACK):
        packed[: max(0, n - k)] |= (data[k:] + 1) << (9 * (PACK - 1 - k))
    levels, size, pair = [(1, data.astype(np.int32))], PACK, packed
    while True:
        order = np.argsort(pair)
        kept = pair[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.r_[0, kept[1:] != kept[:-1]])
        levels.append((size, rank))
        if size >= depth or not n or rank[order[-1]] == n - 1:
            return order, levels
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        pair, size = rank * np.int64(n + 1) + after, 2 * size


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The length of the common prefix of suffixes a and b, at most twice the last level's length less one."""
    n = len(levels[0][1])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for size, rank in [*levels[:0:-1], *[levels[0]] * (PACK - 1)]:
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        step = size * same
        a, b, out = a + step, b + step, out + step
    return out


def previous_smaller(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order the longest common prefix with the nearest place before it that has a smaller position.

    lcp[i] is that of places i - 1 and i. 0 where no place before has a smaller position.
    """
    pos, low = order.tolist(), lcp.tolist()
    stack: list[int] = []
    for i, p in enumerate(pos):
        m = low[i]
        while stack and pos[stack[-1]] > p:
            m = min(m, low[stack.pop()])
        low[i] = m if stack else 0
        stack.append(i)
    return np.array(low, np.int64)


def matches(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order the longest match with an earlier position: the better of both neighbours that are smaller."""
    down = previous_smaller(order[::-1], np.r_[np.zeros(min(1, len(lcp)), np.int64), lcp[1:][::-1]])[::-1]
    return np.maximum(previous_smaller(order, lcp), down)


def longest_factors(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): at each position the longest match, up to about `depth`, with an earlier and with a later position."""
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, levels = suffix_order(data, depth)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefixes(order[:-1], order[1:], levels)
    out = []
    for place in (order, n - 1 - order):
        best = np.empty(n, np.int64)
        best[order] = matches(place, lcp)
        out.append(best)
    return out[0], out[1]


def repeated_starts(contexts: list[bytes], counts: list[int], window: int, earlier_only: bool = False) -> list[np.ndarray]:
    """Of each context the first counts[i] starts, those whose `window` bytes also start at another (an earlier) of these starts.

    Only such starts may match: a context's tail is text of other windows, which have contexts of their own. A start's
    window ends within its context, so one mark can end them all.
    """
    parts, own, at, bounds = [], [], 0, []
    for c, k in zip(contexts, counts, strict=True):
        parts += [np.frombuffer(c, np.uint8).astype(np.int64), MARK]
        bounds.append((at, at + k))
        own.append(np.arange(at, at + k))
        at += len(c) + 1
    data = np.concatenate(parts)
    starts = np.concatenate(own)
    order, levels = suffix_order(data, window)
    mine = np.zeros(len(data), bool)
    mine[starts] = True
    order = order[mine[order]]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefixes(order[:-1], order[1:], levels)
    long = lcp >= window  # a place that matches neither neighbour so far has no match of that length
    near = long | np.r_[long[1:], np.zeros(min(1, len(long)), bool)]
    order, lcp = order[near], np.where(long, lcp, 0)[near]
    hit = np.zeros(len(data), bool)
    for place in (order,) if earlier_only else (order, len(data) - order):
        hit[order[matches(place, lcp) >= window]] = True
    return [np.flatnonzero(hit[x:y]) for x, y in bounds]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = GRAM, hot_least: int = 1000, spread: int = SPREAD, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of docs.

    A byte of a text (UTF-8; null: empty) goes if a string of `window` bytes that covers it also starts anywhere else,
    in the same row or another. Ids don't matter and may be null or repeat: rows with equal texts are copies.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram: 1 to window bytes")
    spark = docs.sparkSession
    cuts = Cuts(spark, "suffixes")
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    sha = F.sha2(text, 256)
    kept = docs.select(col(id_col).cast("long").alias("id"), sha.alias("sha"), text.alias("text"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for group in groups(texts(b.column(2)), AT_ONCE, len):
                h, _, ends = laid_out(group)
                r, _ = runs(h, ends, window, gram)
                cut = np.searchsorted(r.doc, np.arange(len(group) + 1))
                n = len(group)
                found = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(r.key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array([len(t) for t in group], pa.int64()), found], ["id", "sha", "n_bytes", "anchors"])
                at += n

    each = cuts.cut(kept.mapInArrow(survey, "id long, sha string, n_bytes long, anchors array<long>"))
    least_id = -(1 << 63)
    code = F.coalesce("id", F.lit(least_id))
    copies = cuts.cut(each.groupBy("sha").agg(F.count("*").alias("copies"), F.min(code).alias("low")))
    firsts = each.join(copies.where(F.lit(True)).select(F.col("sha").alias("s"), "low"), (F.col("sha") == F.col("s")) & (code == F.col("low")), "left_semi")
    found = cuts.cut(firsts.select("sha", code.alias("low"), F.explode("anchors").alias("akey")))
    recurring = cuts.cut(found.groupBy("akey").agg(F.count("*").alias("n")).where("n > 1"))
    hot = spark.sparkContext.broadcast(hot_keys(recurring, found.count(), hot_least))
    wanted = found.join(recurring, "akey", "left_semi").groupBy("sha", "low").agg(F.collect_set("akey").alias("akeys"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            akeys = b.column(2).to_pylist()
            at = 0
            for group in groups(texts(b.column(1)), AT_ONCE, len):
                h, begin, ends = laid_out(group)
                r, _ = runs(h, ends, window, gram, hot.value)
                size = r.count + window - 1
                place = r.start - begin[r.doc]
                cut = np.searchsorted(r.doc, np.arange(len(group) + 1))
                good = r.moved.copy()
                for k in range(len(group)):
                    x, y = cut[k], cut[k + 1]
                    good[x:y] |= np.isin(r.key[x:y], np.array(akeys[at + k], np.int64).view(np.uint64))
                n = len(group)
                offsets = pa.array(np.r_[0, np.cumsum(good)][cut].astype(np.int32))
                ch = [xxhash.xxh3_128_digest(group[d][p : p + c]) for d, p, c in zip(r.doc[good].tolist(), place[good].tolist(), size[good].tolist(), strict=True)]
                fields = [pa.array(r.key[good].view(np.int64)), pa.array(ch, pa.binary()), pa.array(place[good]), pa.array(r.count[good])]
                lists = [pa.ListArray.from_arrays(offsets, f) for f in fields]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), *lists], ["sha", "text", "akey", "ch", "start", "n"])
                at += n

    code_kept = kept.select("sha", F.coalesce("id", F.lit(least_id)).alias("low"), "text")
    joined = code_kept.join(wanted, ["sha", "low"]).select("sha", "text", "akeys")
    held = joined.mapInArrow(contexts, "sha string, text binary, akey array<long>, ch array<binary>, start array<long>, n array<long>")
    held = cuts.cut(held.dropDuplicates(["sha"]) if not each.groupBy("sha", code).count().where("count > 1").isEmpty() else held)
    hits = held.select("sha", F.inline(F.arrays_zip("akey", "ch", "start", "n")))
    by_context = cuts.cut(hits.groupBy("akey", "ch").agg(F.count("*").alias("c"), F.min(F.struct("sha", "start", "n")).alias("x")))
    several = by_context.groupBy("akey").agg(F.count("*").alias("k"), F.sum(F.col("x.n") + window - 1).alias("bytes")).where("k > 1")
    several = several.select("akey", F.when(F.col("bytes") > spread, F.ceil(F.col("bytes") * 4 / spread)).otherwise(0).cast("int").alias("parts"))
    whole = hits.join(by_context.where("c > 1").select("akey", "ch"), ["akey", "ch"], "left_semi").select("sha", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    # An anchor may have very many contexts: they meet what is known of it in SALTS parts.
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = by_context.withColumn("salt", F.pmod(F.xxhash64("ch"), F.lit(SALTS)).cast("int")).join(several, ["akey", "salt"]).select("x.sha", F.struct("akey", "parts", "c", "x.start", "x.n").alias("x")).groupBy("sha").agg(F.collect_list("x").alias("xs"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        common: dict[tuple, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (akey, parts), held in common.items():
                data, begin, _ = laid_out([x[3] for x in held])
                hs = [Hashes(d).every(window) for d in (data, OTHER[np.frombuffer(b"".join(x[3] for x in held), np.uint8)])]
                at = np.concatenate([np.arange(x, x + h[2]) for x, h in zip(begin, held, strict=True)])
                who = np.repeat(np.arange(len(held)), [h[2] for h in held])
                start = np.concatenate([np.arange(h[1], h[1] + h[2]) for h in held])
                table = np.stack([hs[0][at].view(np.int64), hs[1][at].view(np.int64), who, start], 1)
                part = (hs[0][at] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(ends)):
                    own = table[order[ends[k] : ends[k + 1]]]
                    used, own[:, 2] = np.unique(own[:, 2], return_inverse=True)
                    out.append({"akey": akey, "part": int(k) + 1, "shas": [held[u][0] for u in used], "cs": [held[u][4] for u in used], "windows": own.tobytes()})
            common.clear()
            if out:
                yield pa.RecordBatch.from_pylist(out, PIECE_SCHEMA)
            out.clear()

        for b in batches:
            for sha, t, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for x in xs:
                    context = t[x["start"] : x["start"] + x["n"] + window - 1]
                    size += len(context)
                    if x["parts"]:
                        common.setdefault((x["akey"], x["parts"]), []).append((sha, x["start"], x["n"], context, x["c"]))
                    else:
                        out.append({"akey": x["akey"], "part": 0, "c": x["c"], "sha": sha, "start": x["start"], "n": x["n"], "context": context})
                    if size > 4 << 20:
                        yield from flush()
                        size = 0
        yield from flush()

    pieces = held.select("sha", "text").join(open_, "sha").mapInArrow(cut_out, PIECES)
    dealt = pieces.repartition(partitions(spark), "akey", "part").sortWithinPartitions("akey", "part")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        spread_rows: list[tuple] = []
        size, last = 0, None

        def told(found: list[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            joined = []
            for sha, s in found:
                if len(s):
                    first = np.flatnonzero(np.r_[True, np.diff(s) > 1])
                    end = np.r_[s[first[1:] - 1], s[-1]] + window
                    joined += [(sha, int(a), int(e)) for a, e in zip(s[first], end, strict=True)]
            if joined:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*joined, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["sha", "start", "end"])

        def solve() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if rows:
                found = repeated_starts([x[6] for x in rows], [x[5] for x in rows], window)
                yield from told([(x[3], x[4] + s) for x, s in zip(rows, found, strict=True) if x[2] == 1])
            if spread_rows:
                names, cs, tables, base = [], [], [], 0
                for x in spread_rows:
                    t = np.frombuffer(x[9], np.int64).reshape(-1, 4).copy()
                    t[:, 2] += base
                    base += len(x[7])
                    names += x[7]
                    cs += x[8]
                    tables.append(t)
                t = np.concatenate(tables)
                t = t[np.lexsort((t[:, 1], t[:, 0]))]
                same = (t[1:, :2] == t[:-1, :2]).all(1)
                t = t[np.r_[False, same] | np.r_[same, False]]
                t = t[np.lexsort((t[:, 3], t[:, 2]))]
                who, first = np.unique(t[:, 2], return_index=True)
                yield from told([(names[w], s) for w, s in zip(who, np.split(t[:, 3], first[1:]), strict=True) if cs[w] == 1] if len(t) else [])
            rows.clear()
            spread_rows.clear()
            size = 0

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != last and (size >= SHARD or row[1] or spread_rows):
                    yield from solve()
                last = row[:2]
                if row[1]:
                    spread_rows.append(row)
                else:
                    rows.append(row)
                    size += len(row[6])
        yield from solve()

    matched = dealt.mapInArrow(match, "sha string, start long, end long")
    cutouts = whole.union(matched).groupBy("sha").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for sha, t, starts, stops in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                gone = covered(len(t), np.array(starts), np.array(stops))
                left = np.frombuffer(t, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((sha, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["sha", "removed", "spans", "left_sha", "left"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("sha", pa.string()), ("removed", pa.int64()), ("spans", pa.int64()), ("left_sha", pa.string()), ("left", pa.binary())]))

    changed = cuts.cut(held.select("sha", "text").join(cutouts, "sha").mapInArrow(remove, "sha string, removed long, spans long, left_sha string, left binary"))
    facts = copies.join(changed, "sha", "left")
    out = each.drop("anchors").join(facts, "sha")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    pick = lambda all_, name, none: F.when(copy, all_).otherwise(F.coalesce(name, none))
    cols = [F.col("id").alias("doc_id"), "n_bytes", pick(F.col("n_bytes"), "removed", F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), "spans", F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(hashlib.sha256(b"").hexdigest()), "left_sha", F.col("sha")).alias("kept_sha256")]
    if keep_text:
        source = kept.select("sha", "text").dropDuplicates(["sha"])
        return out.join(source, "sha").select(*cols, pick(F.lit(b""), "left", F.col("text")).alias("kept"))
    return out.select(*cols)
