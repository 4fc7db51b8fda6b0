import numpy as np
import pytest

from gapline.sources import collections as c
from gapline.sources import store
from gapline.streaming import incremental
from tests.test_index import keyed


def test_collection_round_trip(spark, tmp_path):
    k = keyed(spark, [[10, 20, 30, 40], [0], [3, 49]])
    c.write_docs(k, f"{tmp_path}/x.docs", 50)
    assert np.fromfile(f"{tmp_path}/x.docs", "<u4")[:7].tolist() == [1, 50, 4, 10, 20, 30, 40]
    for path in (f"{tmp_path}/x.docs", f"file://{tmp_path}"):
        assert sorted(map(tuple, c.read_docs(spark, path).collect())) == sorted(map(tuple, k.collect()))
    assert tuple(c.read_meta(spark, f"{tmp_path}/x.docs").first()) == (50, 3, 7)


def test_collection_in_parts(spark, tmp_path):
    lists = [list(range(i, 7 * (i % 5) * 40 + i + 1, 7)) for i in range(23)]
    k = keyed(spark, lists)
    want = sorted(map(tuple, k.collect()))
    c.write_docs(k, f"{tmp_path}/one.docs", 9999)
    c.write_docs(k, f"file://{tmp_path}/many", 9999, files=4)
    assert len(c.files_of(f"{tmp_path}/many")) > 1
    for path in (f"{tmp_path}/one.docs", f"file://{tmp_path}/many"):
        assert tuple(c.read_meta(spark, path).first()) == (9999, 23, len(want))
        for split in (4, 10, 100, 1000, 1 << 20):
            assert split > 1000 or len(list(c.parts_of(c.files_of(path)[0], split))) > 1
            if split >= 100:
                spark.dataSource.register(c.DocsSource)
                for got in (spark.read.format("docs").option("splitBytes", split).load(path), c.read_docs(spark, path, split)):
                    assert sorted(map(tuple, got.collect())) == want
            else:
                reader = c._DocsReader({"path": path, "splitBytes": split})
                assert sorted(t for p in reader.partitions() for b in reader.read(p) for t in zip(*(x.to_pylist() for x in b.columns), strict=True)) == want
    c.write_docs(k.limit(0), f"{tmp_path}/none.docs", 5)
    assert c.read_docs(spark, f"{tmp_path}/none.docs").count() == 0
    assert c.read_meta(spark, f"{tmp_path}/none.docs").first().universe_size == 5


@pytest.mark.parametrize("words", [[2, 50, 1, 3], [1, 50, 4, 1, 2], [1]])
def test_broken_collections_are_refused(spark, tmp_path, words):
    np.array(words, "<u4").tofile(tmp_path / "bad.docs")
    with pytest.raises(Exception):  # noqa: B017
        c.read_docs(spark, f"{tmp_path}/bad.docs").collect()


def test_queries_and_keys(spark, tmp_path):
    (tmp_path / "a-2.queries").write_text("3 1 3\n\n7\t8 x 9\n5\n")
    assert [tuple(r) for r in c.read_queries(spark, f"{tmp_path}/a-2.queries").collect()] == [(0, [1, 3]), (1, []), (2, [7, 8]), (3, [5])]
    (tmp_path / "b-2.queries").write_text("4 6\n")
    assert sorted(tuple(r) for r in c.read_queries(spark, f"{tmp_path}/[ab]-2.queries").collect()) == [(0, [1, 3]), (1, []), (2, [7, 8]), (3, [5]), (4, [4, 6])]
    (tmp_path / "e.queries").write_text("")
    assert c.read_queries(spark, f"{tmp_path}/e.queries").count() == 0
    c.write_queries(spark.createDataFrame([(1, [4, 5]), (0, [9])], "query_id long, terms array<long>"), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["4 5", "9"]
    (tmp_path / "k").write_bytes(np.array([3], "<u8").tobytes() + np.array([9, 2, 5], "<u4").tobytes())
    assert [r.key for r in c.read_keys(spark, f"{tmp_path}/k").collect()] == [2, 5, 9]
    c.write_keys(spark.createDataFrame([(9,), (2,), (5,), (2,)], "key long"), f"file://{tmp_path}/w", 64)
    assert [tuple(r) for r in c.read_keys(spark, f"{tmp_path}/w", 64).collect()] == [(0, 2), (1, 2), (2, 5), (3, 9)]


def test_files_go_to_folders_not_yet_there(spark, tmp_path):
    c.write_keys(spark.createDataFrame([(9,), (2,)], "key long"), f"file://{tmp_path}/a/b/keys")
    assert [tuple(r) for r in c.read_keys(spark, f"file://{tmp_path}/a/b/keys").collect()] == [(0, 2), (1, 9)]
    for k in (keyed(spark, [[10, 20]]), keyed(spark, [[1]]).limit(0)):
        c.write_docs(k, f"{tmp_path}/c/{k.count()}/x.docs", 50)
        assert c.read_docs(spark, f"{tmp_path}/c/{k.count()}/x.docs").count() == k.count()


def test_keys_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "PIECE", 100)
    rng = np.random.default_rng(3)
    for bits, top in ((32, (1 << 32) - 1), (64, (1 << 64) - 1)):
        keys = np.r_[rng.integers(0, 1000, 700, np.uint64), rng.integers(0, top, 350, np.uint64), np.full(3, top, np.uint64)]
        want = list(enumerate(np.sort(keys).astype(np.int64).tolist()))
        (tmp_path / f"{bits}").write_bytes(np.array([len(keys)], "<u8").tobytes() + keys.astype(f"<u{bits // 8}").tobytes())  # out of order
        assert [tuple(r) for r in c.read_keys(spark, f"{tmp_path}/{bits}", bits).collect()] == want
        c.write_keys(c.read_keys(spark, f"{tmp_path}/{bits}", bits).repartition(3), f"{tmp_path}/w{bits}", bits)
        assert np.fromfile(tmp_path / f"w{bits}", f"<u{bits // 8}", offset=8).tolist() == np.sort(keys).tolist()
        assert [tuple(r) for r in c.read_keys(spark, f"{tmp_path}/w{bits}", bits).collect()] == want
        assert len(c.key_parts(f"{tmp_path}/w{bits}", bits // 8)) == 11
    two = [tuple(r) for r in c.read_keys(spark, f"{tmp_path}/*32").collect()]  # each numbered for itself
    assert sorted(two) == sorted(2 * [tuple(x) for x in enumerate(np.sort(np.fromfile(tmp_path / "w32", "<u4", offset=8)).tolist())])
    c.write_keys(spark.createDataFrame([], "key long"), f"{tmp_path}/none")
    assert (tmp_path / "none").read_bytes() == bytes(8) and c.read_keys(spark, f"{tmp_path}/none").count() == 0
    for bad in (None, -1, 1 << 32):
        with pytest.raises(Exception, match="a key "):
            c.write_keys(spark.createDataFrame([(5,), (bad,)], "key long"), f"{tmp_path}/bad")
    (tmp_path / "short").write_bytes((3).to_bytes(8, "little") + bytes(11))
    with pytest.raises(ValueError):
        c.read_keys(spark, f"{tmp_path}/short")


def test_stream_is_ingested_once(spark, tmp_path):
    k = keyed(spark, [[1, 2], [3]]).select("list_id", "doc_id")
    k.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(k.schema).parquet(f"{tmp_path}/in")
        incremental.ingest(stream, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, incremental.postings(spark, f"{tmp_path}/table").collect())) == [(0, 1), (0, 2), (1, 3)]


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        def __init__(self, master, folder):
            self.conf = type("Conf", (), {"get": lambda _, key, default: folder, "set": lambda *_: None})()
            self.sparkContext = type("Context", (), {"master": master})()

    assert store.shared_dir(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert store.shared_dir(Session("local[4]", None)).startswith("file:///")
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://a:7077"):
        with pytest.raises(ValueError):
            store.shared_dir(Session(master, None))
