import os

import corpus_pipeline
from gapline.llm import queries as llm
from gapline.llm.common import Cuts, job, shingles, words
from tests.conftest import SF
from tests.llm.fixtures import documents


def test_stages_hold_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "shards":
            assert docs.columns == before.columns
    grams = {r.doc_id: set(shingles(words((r.text or "").encode()), 5)) for r in kept["quality"].collect()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    left = [grams[r.doc_id] for r in kept["near_duplicates"].collect()]
    assert not any(near(a, b) for i, a in enumerate(left) for b in left[:i])
    gone = set(grams) - {r.doc_id for r in kept["near_duplicates"].collect()}
    assert all(any(near(grams[d], grams[e]) for e in grams if e != d) for d in gone)
    items = [set(shingles(words(r.text.encode()), 5)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in kept["near_duplicates"].collect() if any(len(i & grams[r.doc_id]) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in kept["leaks"].collect()} == {r.doc_id for r in kept["near_duplicates"].collect()} - bad
    assert {r.shard for r in kept["shards"].collect()} == set(range(8)) and kept["shards"].count() == kept["mix"].count()


def test_every_query_runs(spark):
    for name, f in llm.queries().items():
        assert f(spark, SF).count() > 0, name


def test_awkward_rows_pass_through_all_stages(spark, tmp_path):
    docs = documents(spark)
    for name, df in (("some", docs), ("none", docs.limit(0))):
        d = f"file://{tmp_path}/{name}"
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (5, 1, 0), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").limit(0 if name == "none" else 9).write.parquet(f"{d}/labels.parquet")
        first = docs.first().text.split()
        spark.createDataFrame([(0, " ".join(first[:9])), (None, None), (2, ""), (3, "one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        before = {}
        stage_docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            before[stage] = stage_docs.columns
            f(spark, stage_docs, d).write.parquet(f"{d}/{stage}")
            stage_docs = spark.read.parquet(f"{d}/{stage}")
        out = corpus_pipeline.run(spark, d)
        assert before["shards"] == docs.columns
        taken = {"size", "slot", "shard"}  # names that the last stage gives to columns of its own
        assert [c for c in out.columns if c not in taken | {"text_crc32", "law", "grown_shard"}] == [c for c in docs.columns if c not in taken]
        assert sorted(map(repr, out.drop("slot").collect())) == sorted(map(repr, stage_docs.drop("slot").collect()))
        texts = {r.text for r in docs.collect()}
        kept = [r.text for r in spark.read.parquet(f"{d}/leaks").collect()]
        assert {r.text for r in out.collect()} <= set(kept) <= texts and bool(kept) == (name == "some")
        if kept:
            ids = [r.doc_id for r in spark.read.parquet(f"{d}/leaks").collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and 0 not in ids  # the benchmark's passage is in row 0


def test_a_job_deletes_what_it_has_cut(spark):
    with job(spark):
        cuts = Cuts(spark, "test")
        cuts.cut(spark.range(3))
        folder = cuts.base.removeprefix("file://")
        assert os.path.exists(folder)
    assert not os.path.exists(folder)
