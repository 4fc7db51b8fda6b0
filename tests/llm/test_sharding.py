import zlib
from collections import Counter, defaultdict

import pytest

from gapline.llm import sharding
from gapline.llm.sharding import LOW, shard_documents, split
from tests.conftest import SF
from tests.llm.fixtures import documents, empty


def test_shards_hold_their_law(spark):
    docs = documents(spark)
    out = shard_documents(docs, 4).collect()
    assert len(out) == docs.count()
    slots, groups, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        t = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        slots[r.shard].append(r.slot)
        groups[t].add(r.shard)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    assert "odd.name" in out[0].asDict() and set(sizes) <= set(range(4))


def test_an_empty_table_and_one_hot_text(spark):
    assert shard_documents(empty(spark)).count() == 0
    hot = spark.range(2000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    out = shard_documents(hot, 8).collect()
    assert len({r.shard for r in out if r.text == "same"}) == 1
    assert {r.doc_id for r in out} == set(range(2000))


def test_splitters_are_exact_and_do_not_depend_on_layout(spark):
    keys = spark.range(5000).selectExpr("pmod(xxhash64(id), 50) as a", "id as b", "pmod(id * 7, 13) + 1 as size")
    one, other = split(keys, 4, 12, whole=False), split(keys.repartition(7), 4, 12, whole=False)
    assert (one.bounds, one.first_slot) == (other.bounds, other.first_slot)
    rows = sorted((r.a, r.b, r.size) for r in keys.collect())
    total, at = sum(r[2] for r in rows), Counter()
    for a, b, s in rows:
        at[one.shard[sum(k <= (a, b) for k in one.bounds)]] += s
    assert all(abs(at[k] - total / 4) <= 0.005 * total / 4 + 14 for k in range(4))
    assert split(keys.limit(0), 4, 12).bounds == [] and LOW < 0


@pytest.mark.parametrize("probes", [sharding.PROBES, 16])
def test_shards_are_near_equal_in_bytes(spark, monkeypatch, probes):
    monkeypatch.setattr(sharding, "PROBES", probes)
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = shard_documents(docs, 8, columns=["doc_id"]).collect()
    sizes, groups = Counter(), Counter()
    for r in out:
        sizes[r.shard] += r.size
        groups[r.text_crc32, r.size] += r.size
    mean = sum(sizes.values()) / 8
    assert len(out) == docs.count() and set(sizes) == set(range(8))
    assert all(abs(n - mean) <= 0.005 * mean + max(groups.values()) for n in sizes.values())
