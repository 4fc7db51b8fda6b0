"""Small tables with the awkward rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, fp long, shard string, size double, slot int, a long, b long, target string, `odd.name` string"


def documents(spark, seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "the", "THE", "ſecret"]
    some = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    some += [some[0], some[0], some[1] + " tail", "", "   \t\n", "one", "two words", None, some[2].upper(), " ".join(rng.choice(vocabulary) for _ in range(4000))]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "s3", None, ""]), len(t or "")) for i, t in enumerate(some)]
    rows += [rows[3], rows[3], (None, some[0], None, None, None), (None, None, None, None, None), (7, some[9], "en", "s1", 3)]
    return spark.createDataFrame([(*r, 1, "k", 2, "x", 0.5, 3, 4, 5, "t", "o") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


__all__ = ["Row", "documents", "empty", "rows"]
