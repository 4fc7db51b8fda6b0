import math
import random

import numpy as np

from gapline.llm.topk import Buckets, Queries, best, products, top_k


def test_matches_brute_force_with_awkward_vectors(spark):
    rng = random.Random(2)
    vec = lambda d, s: [rng.gauss(0, s) for _ in range(d)]
    rows = [(i, vec(8, rng.choice([0.1, 1, 5])), 0, "x") for i in range(600)]
    rows += [(i, rows[5][1], 0, "x") for i in range(600, 640)]
    rows += [(700, None, 0, "x"), (None, vec(8, 1), 0, "x"), (701, [None] * 8, 0, "x"), (702, [math.nan] * 8, 0, "x"), (703, [math.inf] * 8, 0, "x"), (800, vec(3, 1), 0, "x"), (801, vec(3, 1), 0, "x"), (802, [], 0, "x"), (900, [1e14] * 3, 0, "x"), (0, rows[0][1], 0, "x"), (7, rows[7][1], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string")
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {i: v for i, v in good if i % 100 == 0}
    want = []
    for q, v in queries.items():
        scores = sorted(((-max(min(sum(a * b for a, b in zip(v, c)), (1 << 63) - 1), -(1 << 63)), i) for i, c in good if i != q and len(c) == len(v)))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    for block in (1 << 20, 300):
        assert sorted(map(tuple, top_k(df, block_bytes=block).collect())) == sorted(want)
    assert top_k(df.limit(0)).count() == 0


def test_search_is_exact_for_dominant_coordinates():
    rng = np.random.default_rng(4)
    sets = [rng.integers(-1000, 1001, (400, 1)), np.c_[rng.choice([-1000, 1000], 400), rng.integers(-40, 41, (400, 3))]]
    sets += [np.array([[-950, 180, 180, 180], [-800, 346, 346, 346], [-1000, 0, 0, 0]]), np.r_[np.eye(4, dtype=int) * 1000, np.eye(4, dtype=int) * -1000, rng.integers(-300, 301, (200, 4))]]
    for v in (x.astype(float) for x in sets):
        ids = np.arange(len(v))
        some = np.arange(min(len(v), 60))
        for size in (1, 7, len(v)):
            for k in (1, 5):
                s = products(v[some], v)
                s[some, some] = -(1 << 62)
                want = [best(x, ids, k)[: len(v) - 1] for x in s]
                known = [int(x[w[-1]]) - 1 if len(w) == k else None for x, w in zip(s, want)]
                for least in ([None] * len(some), known):
                    q = Queries(some, v[some], least, k)
                    for at in range(0, len(v), size):
                        Buckets(ids[at : at + size], v[at : at + size]).search(q)
                    assert all(f[1].tolist() == w.tolist() and f[0].tolist() == x[w].tolist() for f, x, w in zip(q.found, s, want))
