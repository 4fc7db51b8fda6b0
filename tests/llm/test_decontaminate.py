from gapline.llm.common import shingles, words
from gapline.llm.decontaminate import decontaminate, search
from tests.llm.fixtures import documents, empty


def items(spark, docs):
    texts = [r.text for r in docs.where("length(text) > 80").select("text").limit(12).collect()]
    cut = [" ".join(t.split()[2:14]) for t in texts] + [" ".join(t.split()[1:9] + ["other"]) for t in texts] + ["two words", "", None, "one", "no such thing at all here"]
    return spark.createDataFrame([*enumerate(cut), (0, cut[0]), (None, cut[1])], "item_id long, text string")


def test_search_matches_brute_force(spark):
    docs = documents(spark)
    it = items(spark, docs)
    grams = lambda t: set(shingles(words((t or "").encode()), 5))
    want = []
    for d in docs.select("doc_id", "text").collect():
        for i in it.collect():
            a, b = grams(i.text), grams(d.text)
            if a and len(a & b) >= 0.8 * len(a):
                want.append((d.doc_id, i.item_id, len(a & b), len(a), len(a & b) / len(a)))
    assert want
    for size in (1_000_000, 20):
        assert sorted(map(tuple, search(docs, it, block_shingles=size).collect()), key=repr) == sorted(want, key=repr)


def test_decontaminate_keeps_the_rest_whole(spark):
    docs = documents(spark)
    it = items(spark, docs)
    bad = {r.doc_id for r in search(docs, it).collect()} - {None}
    kept = decontaminate(docs, it)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in docs.collect() if r.doc_id not in bad), key=repr)
    assert search(empty(spark), it).count() == 0 and search(docs, it.limit(0)).count() == 0 and decontaminate(docs, it.limit(0)).count() == docs.count()
