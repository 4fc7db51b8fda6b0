"""Repeated passages of words: removed wherever an earlier document has them.

1. Content-defined anchors (short phrases) of every document are counted; those in more than one document recur.
2. The recurring phrases are confirmed as text, over the documents that have them.
3. Aho-Corasick automata are compiled of confirmed phrases, one set per shard of documents with the phrases that may
   occur there, and the shard's documents stream through them; every hit gives the context of its windows.
4. Equal contexts, and equal windows of different contexts of one phrase, are resolved to their earliest document by
   sums that combine before they are exchanged. Contexts and windows are compared by 128-bit digests of their text: among
   n different ones the chance that any two agree is below n ** 2 / 2 ** 129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.anchors import covered, runs
from gapline.llm.common import Cuts, col, partitions, texts
from gapline.llm.decontaminate import Vocabulary

GRAM = 8  #: words of a phrase
AT_ONCE = 200_000  #: words laid end to end at a time, or one document
AUTOMATON = 25_000  #: phrases of a shard on average, at most; an automaton has twice as many at most
SALTS = 16
HOT_KEYS = 1_000_000  #: at most so many phrases are hot, which is what is broadcast
EMPTY = hashlib.sha256(b"").hexdigest()


def groups(docs: list, at_once: int, size) -> Iterator[list]:
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += size(d)
        if n >= at_once:
            yield held
            held, n = [], 0
    if held:
        yield held


def laid_out(docs: list[list[bytes]], seen: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of docs end to end, and where each begins and ends."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    h = np.fromiter((seen[w] for d in docs for w in d), np.uint64, int(ends[-1]) if len(docs) else 0)
    return h, ends - sizes, ends


def hot_keys(recurring: DataFrame, total: int, least: int) -> np.ndarray:
    """Keys with over max(least, total / HOT_KEYS) occurrences; there are at most HOT_KEYS of them."""
    got = recurring.where(F.col("n") > max(least, total // HOT_KEYS)).select("akey").toPandas()
    return np.sort(got["akey"].to_numpy(np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = GRAM, hot_least: int = 1000, keep_text: bool = False, automaton: int = AUTOMATON, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of docs.

    Words are runs of bytes other than space and \\x09-\\x0D, unchanged. A word goes if a window of `window` words that
    covers it also starts in a document with a smaller doc_id. Null texts have no words. Rows with a null id lose
    nothing and make others lose nothing. Rows that repeat an id are judged each for itself, against smaller ids only.
    automaton: phrases of a shard, of which there are as many as that takes. digest: of a context's or window's text.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram: 1 to window words")
    spark = docs.sparkSession
    cuts = Cuts(spark, "phrases")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    kept = docs.select(col(id_col).cast("long").alias("id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"), text.alias("text"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Vocabulary()
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            for group in groups([t.split() for t in texts(b.column(2))], AT_ONCE, len):
                h, _, ends = laid_out(group, seen)
                r, _ = runs(h, ends, window, gram)
                cut = np.searchsorted(r.doc, np.arange(len(group) + 1))
                found = [np.unique(r.key[x:y]).view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                own = slice(at, at := at + len(group))
                shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in group]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(keys[own], pa.binary()), pa.array([len(w) for w in group], pa.int64()), pa.array(shas, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["id", "key", "n_words", "sha", "anchors"])

    each = cuts.cut(kept.mapInArrow(survey, "id long, key binary, n_words long, sha string, anchors array<long>"))
    lows = cuts.cut(each.where((F.col("n_words") >= window) & F.col("id").isNotNull()).groupBy("key").agg(F.min("id").alias("low")))
    firsts = each.join(lows.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("low")), "left_semi")
    found = cuts.cut(firsts.select("id", "key", F.explode("anchors").alias("akey")))
    counted = found.groupBy("akey").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("x < y")
    recurring = cuts.cut(counted.select("akey", "n"))
    hot = spark.sparkContext.broadcast(hot_keys(recurring, found.count(), hot_least))
    wanted = found.join(recurring, "akey", "left_semi").groupBy("id", "key").agg(F.collect_list("akey").alias("akeys"))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Vocabulary()
        for b in batches:
            ids, keys, held, akeys = (b.column(k) for k in range(4))
            akeys = akeys.to_pylist()
            at = 0
            for group in groups([t.split() for t in texts(held)], AT_ONCE, len):
                h, begin, ends = laid_out(group, seen)
                r, _ = runs(h, ends, window, gram, hot.value)
                out = []
                cut = np.searchsorted(r.doc, np.arange(len(group) + 1))
                for k, w in enumerate(group):
                    x, y = cut[k], cut[k + 1]
                    known = np.isin(r.key[x:y], np.array(akeys[at + k], np.int64).view(np.uint64)) | r.moved[x:y]
                    out.append([b" ".join(w[p : p + gram]) for p in np.unique(r.anchor[x:y][known]) - begin[k]])
                n = len(group)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), keys.slice(at, n), held.slice(at, n), pa.array([list(dict.fromkeys(o)) for o in out], pa.list_(pa.binary()))], ["id", "key", "text", "phrases"])
                at += n

    joined = kept.join(wanted, ["id", "key"]).select("id", "key", "text", "akeys")
    held = cuts.cut(joined.mapInArrow(phrases, "id long, key binary, text string, phrases array<binary>"))
    said = held.select("id", "key", F.explode("phrases").alias("phrase"))
    confirmed = said.groupBy("phrase").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("phrase")
    shards = max(partitions(spark), -(-said.count() // automaton))
    shard = F.pmod(F.xxhash64("id", "key"), F.lit(shards)).cast("int").alias("shard")
    sent = said.select(shard, "phrase").distinct().join(confirmed, "phrase", "left_semi")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = sent.select("shard", F.lit(0).alias("kind"), none("long", "id"), none("binary", "key"), F.col("phrase").alias("text")).union(held.select(shard, F.lit(1), "id", "key", F.col("text").cast("binary")))
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind").drop("shard")

    def parts(w: list[bytes], start: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Digests of n words of w from each start on, joined by spaces."""
        if not len(start):
            return []
        line = b" ".join(w)
        at = np.r_[0, np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)]
        return [digest(line[x:y]) for x, y in zip(at[start].tolist(), (at[start + n] - 1).tolist(), strict=True)]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, automata, last, n = Vocabulary(), [], None, 0

        def add(phrase: bytes) -> None:
            nonlocal last, n
            if last is None or n >= 2 * automaton:
                last, n = ahocorasick.Automaton(), 0
                automata.append(last)
            last.add_word(f" {phrase.decode('latin-1')} ", 1)
            n += 1

        ready = False
        for b in batches:
            kind = b.column(0).to_numpy()
            split = int(np.searchsorted(kind, 1))
            for p in b.column(3).slice(0, split).to_pylist():
                add(p)
            if split == len(kind):
                continue
            if not ready:
                for a in automata:
                    a.make_automaton()
                ready = True
            ids, keys = b.column(1).slice(split).to_pylist(), b.column(2).slice(split).to_pylist()
            at = 0
            for group in groups([(t or b"").split() for t in b.column(3).slice(split).to_pylist()], AT_ONCE, len):
                h, begin, ends = laid_out(group, seen)
                r, _ = runs(h, ends, window, gram, hot.value)
                hit = np.zeros(len(h) + 1, bool)
                for k, w in enumerate(group):
                    line = f" {b' '.join(w).decode('latin-1')} "
                    stops = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)  # where the space after each word is
                    for a in automata:
                        over = np.fromiter((e for e, _ in a.iter(line)), np.int64)
                        if len(over):
                            hit[begin[k] + np.searchsorted(stops, over) - gram + 1] = True
                good = hit[r.anchor]
                start, count, doc, akey = r.start[good], r.count[good], r.doc[good], r.key[good].view(np.int64)
                place = start - begin[doc]
                cut = np.searchsorted(doc, np.arange(len(group) + 1)).tolist()
                ch = [x for k, w in enumerate(group) for x in parts(w, place[cut[k] : cut[k + 1]], count[cut[k] : cut[k + 1]] + window - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[at + d] for d in doc], pa.int64()), pa.array([keys[at + d] for d in doc], pa.binary()), pa.array(akey), pa.array(ch, pa.binary()), pa.array(place), pa.array(count)], ["id", "key", "akey", "ch", "start", "n"])
                at += len(group)

    hits = cuts.cut(dealt.mapInArrow(stream, "id long, key binary, akey long, ch binary, start long, n long"))
    contexts = cuts.cut(hits.groupBy("akey", "ch").agg(F.min("id").alias("first")))
    several = contexts.groupBy("akey").agg(F.count("*").alias("n"), F.min("first").alias("x"), F.max("first").alias("y")).where("n > 1 and x < y")
    # A phrase may have very many contexts: they meet what is known of it in SALTS parts, and hits meet them by context.
    several = several.select("akey", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("open"))
    contexts = contexts.withColumn("salt", F.pmod(F.xxhash64("ch"), F.lit(SALTS)).cast("int")).join(several, ["akey", "salt"], "left").drop("salt")
    owned = hits.join(contexts, ["akey", "ch"])
    whole = owned.where("first < id").select("id", "key", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    # Of different contexts of one phrase, each at its earliest document, all windows are compared.
    asked = owned.where("first = id and open").groupBy("id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, (t, found) in enumerate(zip(texts(b.column(2)), b.column(3).to_pylist(), strict=True)):
                starts = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in found]))
                own = pa.array(parts(t.split(), starts, np.full(len(starts), window)), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[n], len(starts)), pa.repeat(b.column(1)[n], len(starts)), own, pa.array(starts)], ["id", "key", "h", "start"])

    told = held.select("id", "key", "text").dropDuplicates(["id", "key"]) if not held.groupBy("id", "key").count().where("count > 1").isEmpty() else held.select("id", "key", "text")
    single = cuts.cut(told.join(asked, ["id", "key"]).mapInArrow(windows, "id long, key binary, h binary, start long"))
    earliest = cuts.cut(single.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("y")).where("first < y").drop("y"))
    late = single.join(earliest, "h").where("first < id").select("id", "key", "start", (F.col("start") + window).alias("end"))
    cutouts = whole.union(late).groupBy("id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, shas, left = [], [], []
            for t, starts, stops in zip(texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                w = t.split()
                gone = covered(len(w), np.array(starts), np.array(stops))
                removed.append(int(gone.sum()))
                left.append(b" ".join([x for x, g in zip(w, gone, strict=True) if not g]))
                shas.append(hashlib.sha256(left[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(left if keep_text else [None] * len(left), pa.binary())], ["id", "key", "removed", "left_sha", "left"])

    changed = held.select("id", "key", "text").join(cutouts, ["id", "key"]).mapInArrow(remove, "id long, key binary, removed long, left_sha string, left binary")
    changed = cuts.cut(changed.dropDuplicates(["id", "key"]))
    out = each.drop("anchors").join(lows, "key", "left").join(changed, ["id", "key"], "left")
    copy = F.coalesce(F.col("low") < F.col("id"), F.lit(False))
    cols = [F.col("id").alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256")]
    if keep_text:
        joined = F.array_join(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), " ")
        source = kept.select(F.col("key").alias("k"), joined.alias("joined")).dropDuplicates(["k"])
        out = out.join(source, F.col("key") == F.col("k"))
        return out.select(*cols, F.when(copy, F.lit("")).otherwise(F.coalesce(F.col("left").cast("string"), "joined")).alias("kept"))
    return out.select(*cols)
