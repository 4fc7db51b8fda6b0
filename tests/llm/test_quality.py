import zlib

import numpy as np

from gapline.llm.quality import BINS, N_STATS, classify, dealt, fit, isotonic, keep_good
from tests.conftest import SF
from tests.llm.fixtures import documents, empty


def test_isotonic_is_the_non_decreasing_fit():
    rng = np.random.default_rng(0)
    w, y = rng.uniform(0.1, 2, 50), rng.normal(size=50) + np.linspace(0, 2, 50)
    f = isotonic(w, y)
    assert (np.diff(f) >= 0).all() and abs((w * (f - y)).sum()) < 1e-9
    assert isotonic(np.ones(3), np.array([3.0, 2.0, 1.0])).tolist() == [2, 2, 2]


def test_fit_matches_dense_algebra_in_any_layout(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, N_STATS)) * rng.uniform(0.1, 5, N_STATS)
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.2).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id long, stats array<double>, y int")
    m = fit(rows, dim=20)
    z, weight = m.fourier(x), np.array([0.5 * 300 / (300 - y.sum()), 0.5 * 300 / y.sum()])[y]
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0))
    dense = lambda own: np.linalg.lstsq(np.r_[z[own] * np.sqrt(weight[own])[:, None], np.sqrt(1e-4 * own.sum()) * np.eye(z.shape[1])], np.r_[y[own] * np.sqrt(weight[own]), np.zeros(z.shape[1])], rcond=None)[0]
    assert np.allclose(m.beta, dense(np.ones(300, bool)), atol=1e-6)
    fold = {r.id: r.k for r in dealt(rows).select("id", "k").collect()}
    k = np.array([fold[i] for i in range(300)])
    raw = np.array([z[i] @ dense(k != k[i]) for i in range(300)])
    at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
    bins = np.unique(at)
    share = isotonic(np.array([(at == b).sum() for b in bins]), np.array([y[at == b].mean() for b in bins]))
    assert np.allclose(m.ys, np.clip(share, 0, 1), atol=1e-6)
    again = fit(rows.repartition(7), dim=20)
    assert all(getattr(m, f).tobytes() == getattr(again, f).tobytes() for f in ("mean", "scale", "beta", "xs", "ys"))


def test_held_out_accuracy(spark):
    d = SF.replace("0.001", "0.1")
    out = classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert len(out) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([p == y for p, y in held]) >= 0.98
    assert np.mean([p == 0 for p, y in held if y == 0]) >= 0.9


def test_held_out_labels_are_never_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    assert sorted(map(tuple, classify(docs, labels).collect())) == sorted(map(tuple, classify(docs, turned).collect()))


def test_awkward_rows(spark):
    docs = documents(spark)
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (5, 1), (6, 0), (8, 1)], "doc_id long, quality int")
    out = classify(docs, some).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    for none in (some.limit(0), some.where("quality = 1")):
        assert {r.predicted for r in classify(docs, none).collect()} == {1}
    assert keep_good(docs, some.limit(0)).count() == docs.count()
    assert classify(empty(spark), some).count() == 0 and keep_good(docs, some).columns == docs.columns
