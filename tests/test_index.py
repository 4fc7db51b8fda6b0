import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapline.operators import codec, gaps, partition, patched, search, stats, validate
from gapline.plans.index import build
from gapline.sources import store


def keyed(spark, lists):
    return spark.createDataFrame([(i, p, d) for i, ids in enumerate(lists) for p, d in enumerate(ids)], "list_id long, pos long, doc_id long")


SKEWED = np.cumsum(np.r_[0, np.ones(3000, int), np.tile(np.arange(1, 1001), 3), np.ones(3000, int)]).tolist()
LISTS = [[10, 20, 30, 40], [5], [7, 9], list(range(0, 3072, 3)), list(range(0, 2050, 2)), [0, 2147483646], SKEWED]


def test_golden_vector(spark):
    s = build(keyed(spark, [[10, 20, 30, 40]]), 1)
    r = s.first()
    assert (r.first, r.covered, r.delta_y, r.delta_x, r.y_b, r.x_b, r.residuals) == (0, 4, 32, 3, 9, 0, [1, 0, 0, -1])
    codes = codec.delta_codes(s).orderBy("pos").collect()
    assert [c.delta for c in codes] == [1, -1, 0, -1] and [c.code for c in codes] == [2, 1, 0, 1]
    size = codec.index_sizes(s).first()
    assert (size.w_covered, size.w_delta_y, size.w_delta_x, size.w_y_b, size.w_x_b) == (3, 6, 2, 4, 0)
    assert (size.segment_bytes, size.correction_bytes, size.sign_bytes, size.total_bytes) == (33, 8, 0, 41)


@pytest.mark.parametrize("how", [{"epsilon": 1}, {"epsilon": 63}, {"epsilon": 5}, {}, {"variant": "pfor"}, {"method": "optimal", "m": 4}, {"m": 8}])
def test_round_trip(spark, how):
    k = keyed(spark, LISTS)
    s = build(k, **how)
    want = sorted(map(tuple, k.collect()))
    assert sorted(map(tuple, codec.decode(s).collect())) == want
    assert sorted(map(tuple, codec.decode_codes(codec.delta_codes(s)).collect())) == want
    assert validate.mismatches(k, codec.decode(s)).where("n_unequal > 0").count() == 0


def test_positions_and_gaps(spark):
    k = keyed(spark, LISTS)
    again = stats.positions(k.select("list_id", "doc_id").repartition(5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, k.collect()))
    assert sorted(map(tuple, gaps.decode(gaps.encode(k)).collect())) == sorted(map(tuple, k.collect()))
    last = {r.list_id: r for r in stats.gap_prefix(k).orderBy("pos").collect()}
    assert all(last[i].sum_gap == ids[-1] - ids[0] and last[i].sum_gap2 == sum((b - a) ** 2 for a, b in zip(ids, ids[1:])) for i, ids in enumerate(LISTS))
    assert stats.positions(k.limit(0).select("list_id", "doc_id")).count() == 0


def test_skewed_list_splits(spark):
    k = keyed(spark, [SKEWED])
    eps = [r.epsilon for r in stats.page_model(stats.pages(k)).orderBy("page").collect()]
    assert eps == [1, 1, 63, 2047, 2047, 2047, 1, 1, 1]
    b = partition.blocks(stats.pages(k)).orderBy("start_idx").collect()
    assert len(b) > 1 and b[0].start_idx == 0 and b[-1].end_idx == len(SKEWED) and all(x.end_idx == y.start_idx and x.epsilon != y.epsilon for x, y in zip(b, b[1:]))


def test_partitioners_match_brute_force():
    rng = np.random.default_rng(1)
    ids = np.cumsum(rng.integers(1, 300, 5 * 1024))
    pages = np.split(ids, 5)
    args = np.full(5, 1024), np.array([x[0] for x in pages]), np.array([x[-1] for x in pages]), [int((np.diff(x) ** 2).sum()) for x in pages]
    r = partition.Ranges(*args, 136, partition.C)
    for a in range(5):
        for b in range(a + 1, 6):
            g = np.diff(ids[a * 1024 : b * 1024])
            assert abs(r.variance(a, b)[1] - g.var(ddof=1)) < 1e-6 * g.var()
    import itertools

    best = min(sum(r.cost(x, y) for x, y in zip((0, *c), (*c, 5))) for c in itertools.combinations(range(1, 5), 2))
    assert abs(sum(r.cost(*x) for x in partition.optimal(r, 3)) - best) < 1e-6
    assert partition.greedy(r, 1) == [(0, 5)] and partition.greedy(r, 99) == [(i, i + 1) for i in range(5)]
    assert partition.greedy(partition.Ranges(*args, 136, 0.0), 99) == [(0, 5)]


def test_search_strategies_agree(spark):
    k = keyed(spark, LISTS)
    q = spark.createDataFrame([(0, [3, 4]), (1, [3, 4, 6]), (2, [0, 0, 3]), (3, [5]), (4, [99, 3]), (5, [])], "query_id long, terms array<long>")
    for op, plain in (("and", search.and_query), ("or", search.or_query)):
        sets = {i: ([set(LISTS[t]) if t < len(LISTS) else set() for t in set(ts)]) for i, ts in [(r.query_id, r.terms) for r in q.collect()]}
        want = sorted((i, d) for i, s in sets.items() if s for d in (set.intersection(*s) if op == "and" else set.union(*s)))
        assert sorted(map(tuple, plain(k, q).collect())) == want
        assert sorted(map(tuple, search.by_arrays(k, q, op).collect())) == want
        n = {i: sum(x == i for x, _ in want) for i in sets}
        assert {r.query_id: r.n for r in search.counts(plain(k, q), q).collect()} == n
        assert {r.query_id: r.n for r in search.bitmap_counts(k, q, op).collect()} == {i: c for i, c in n.items() if c}
    assert sorted(map(tuple, search.and_semi(k, q).collect())) == sorted(map(tuple, search.and_query(k, q).collect()))
    assert {r.doc_id for r in search.and_not(k, q.where("query_id = 0")).collect()} == set(LISTS[3]) - set(LISTS[4])
    assert [r.query_id for r in search.valid_queries(q).orderBy("query_id").collect()] == [0, 1, 2, 4]


def test_next_geq_and_cursor(spark):
    k = keyed(spark, LISTS)
    probes = [(6, x) for x in (0, 5, 3000, 3001, 700_000, SKEWED[-1], SKEWED[-1] + 1)] + [(1, 5), (1, 6), (42, 1)]
    got = {(r.list_id, r.x): r.doc_id for r in search.next_geq(k, spark.createDataFrame(probes, "list_id long, x long")).collect()}
    assert got == {(i, x): min((d for d in (LISTS[i] if i < len(LISTS) else []) if d >= x), default=None) for i, x in probes}
    asked = spark.createDataFrame(probes, "list_id long, x long")
    for epsilon in (1, 15, 255, 0):
        assert {(r.list_id, r.x): r.doc_id for r in search.seek_segments(build(k, epsilon), asked).collect()} == got
    seen = {(r.list_id, r.x): (r.doc_id, r.n_skipped) for r in search.seek_gaps(gaps.encode(k), asked).collect()}
    assert seen == {(i, x): (d, None if d is None else LISTS[i].index(d) // 128 * 128) for (i, x), d in got.items()}
    assert {(r.list_id, r.doc_id): r.next_id for r in search.cursor(k).collect()} == {(i, a): b for i, ids in enumerate(LISTS) for a, b in zip(ids, [*ids[1:], None])}


def test_validation(spark):
    k = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 2, 4), (1, 0, 50), (3, 0, -1)], "list_id long, pos long, doc_id long")
    meta = spark.createDataFrame([(50, 4)], "universe_size long, n_lists long")
    assert sorted(map(tuple, validate.violations(k, meta).collect())) == [(0, 1, "order"), (0, 2, "order"), (1, 0, "range"), (3, 0, "range")]
    assert [r.list_id for r in validate.empty_lists(k, meta).collect()] == [2]


def test_store_and_packed_records(spark, tmp_path):
    k = keyed(spark, LISTS)
    s = build(k, 15)
    store.save(s, f"file://{tmp_path}/i", buckets=4, extra={"lists": k.groupBy("list_id").count()})
    want = sorted(map(tuple, k.collect()))
    assert sorted(map(tuple, codec.decode(store.load(spark, f"file://{tmp_path}/i")).collect())) == want
    some = spark.createDataFrame([(0,), (6,), (77,)], "list_id long")
    part = store.load(spark, f"file://{tmp_path}/i", some)
    assert sorted(map(tuple, codec.decode(part).collect())) == [x for x in want if x[0] in (0, 6)]
    assert [r.list_id for r in store.missing(part, some).collect()] == [77]
    for how in ({"epsilon": 15}, {}):
        t = build(k, **how)
        assert sorted(map(tuple, codec.decode(store.restore(store.export(t))).collect())) == want
    for r in store.export(s).collect():
        epsilon, segs = store.parse(bytes(r.record))
        own = [x.asDict() for x in s.where((F.col("list_id") == r.list_id) & (F.col("block_id") == r.block_id)).orderBy("first").collect()]
        assert epsilon == 15 and segs == [{f: x[f] for f in (*store.FIELDS, "first", "residuals")} for x in own]


def test_next_geq_over_far_ranges(spark):
    lists = [[5, 6, (5 << 20) + 1, (5 << 20) + 9, (9 << 20)], list(range(0, 3 << 20, 997)), [(1 << 31) - 2]]
    k = keyed(spark, lists)
    xs = [-3, 0, 5, 6, 7, 1 << 20, (5 << 20), (5 << 20) + 2, (5 << 20) + 10, 9 << 20, (9 << 20) + 1, 1 << 31]
    probes = spark.createDataFrame([(i, x) for i in range(4) for x in xs], "list_id long, x long")
    want = [(i, x, min((d for d in (lists[i] if i < 3 else []) if d >= x), default=None)) for i in range(4) for x in xs]
    for got in (search.next_geq(k, probes), search.seek_segments(build(k, 7), probes), search.seek_gaps(gaps.encode(k), probes)):
        assert sorted(map(tuple, got.select("list_id", "x", "doc_id").collect()), key=repr) == sorted(want, key=repr)


def test_record_files(spark, tmp_path):
    k = keyed(spark, LISTS)
    want = sorted(map(tuple, k.collect()))
    for name, how, parted in (("a", {}, True), ("b", {"epsilon": 15}, False)):
        store.save_idx(build(k, **how), f"file://{tmp_path}/{name}", parted)
        assert sorted(map(tuple, codec.decode(store.load_idx(spark, f"file://{tmp_path}/{name}")).collect())) == want
    assert (tmp_path / "a" / "6_1.idx").exists() and (tmp_path / "b" / "6.idx").exists()
    assert (tmp_path / "b" / "idx.size").read_bytes() == len(want).to_bytes(8, "little") + len(LISTS).to_bytes(4, "little")
    store.save_idx(build(keyed(spark, LISTS[:1]), 1), f"file://{tmp_path}/g", False)
    head = (tmp_path / "g" / "0.idx").read_bytes()
    # epsilon, keys, segments, widths; then words of covered 4, delta_y 32, delta_x 3, y_b 9, x_b 0; magnitudes 1, 0, 0, 1 in a bit each, and signs
    words = [(1, 4), (1, 32), (1, 3), (1, 9), (0, None), (1, 0b1001)]
    expected = (1).to_bytes(4, "little") + (4).to_bytes(8, "little") + (1).to_bytes(4, "little") + bytes([3, 6, 2, 4, 0])
    expected += b"".join(n.to_bytes(8, "little") + (v.to_bytes(8, "little") if n else b"") for n, v in words)
    assert head == expected + (4).to_bytes(8, "little") + bytes([0b1000])
    (tmp_path / "b" / "6.idx").unlink()
    with pytest.raises(ValueError):
        store.load_idx(spark, f"file://{tmp_path}/b")


def test_record_files_of_any_length(spark, tmp_path):
    lists = [list(range(0, 3 * n, 3)) for n in (1, 127, 128, 195, 224, 240, 255, 256, 1219, 52_960)]  # of which some bytes begin a character of UTF-8
    k = keyed(spark, lists)
    store.save_idx(build(k, 3), f"file://{tmp_path}/x")
    got = codec.decode(store.load_idx(spark, f"file://{tmp_path}/x"))
    assert validate.mismatches(k, got).where("n_unequal > 0").count() == 0 and got.count() == sum(map(len, lists))


def test_record_files_as_streams(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    for step in (64, 1 << 16):
        monkeypatch.setattr(store, "STEP", step)
        monkeypatch.setattr(store, "SPOOL", 1000)
        for epsilon in (0, 1, 63):
            for n in (0, 1, 63, 64, 65, 3000):
                size = rng.integers(1, 90, n)
                segs = [{f: int(rng.integers(0, 1 << 31)) for f in store.FIELDS} | {"covered": int(c), "residuals": rng.integers(-epsilon, epsilon + 1, c).tolist()} for c in size]
                block = store.Block(epsilon)
                for x in range(0, n, 17):
                    some = segs[x : x + 17]
                    block.add(np.array([[g[f] for f in store.FIELDS] for g in some]), np.concatenate([np.array(g["residuals"], np.int64) for g in some]))
                data = b"".join(block.bytes())
                assert n == 0 or data == store.record(epsilon, segs)
                file = store.RecordFile(pa.BufferReader(data), "x")
                ends = np.r_[0, np.cumsum(size)]
                for x, y in ((0, n), (n // 3, n // 2), (n - n // 5, n)):
                    assert file.covered(x, y - x).tolist() == size[x:y].tolist()
                    assert file.column(4, file.width[4], x, y - x).tolist() == [g["x_b"] for g in segs[x:y]]
                    assert file.residuals(int(ends[x]), int(ends[y] - ends[x])).tolist() == [r for g in segs[x:y] for r in g["residuals"]]
                for bad in (data[:-1] if n else data[:-8], data + b"x", data[:10]):
                    with pytest.raises(ValueError):
                        store.RecordFile(pa.BufferReader(bad), "x")
    monkeypatch.undo()
    monkeypatch.setattr(store, "CHUNK", 500)  # of the files' parts, not of the fit
    k = keyed(spark, LISTS)
    store.save_idx(build(k), f"{tmp_path}/x")
    assert not [p.name for p in (tmp_path / "x").iterdir() if p.name != "idx.size" and p.suffix != ".idx"]
    loaded = store.load_idx(spark, f"{tmp_path}/x")
    assert sorted(map(tuple, codec.decode(loaded).collect())) == sorted(map(tuple, k.collect()))
    columns = [c for c in loaded.columns if c != "block_id"]
    assert sorted(map(tuple, loaded.select(columns).collect())) == sorted(map(tuple, build(k).select(columns).collect()))
    store.save_idx(build(k.limit(0), 1), f"{tmp_path}/none")
    assert store.load_idx(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="several blocks"):
        store.save_idx(build(keyed(spark, [SKEWED])), f"{tmp_path}/y", False)


def test_patched_frames(spark):
    rng = np.random.default_rng(8)
    for n in (0, 1, 255, 256, 257, 1000):
        for top in (1, 2, 100, 1 << 40, 1 << 61):
            c = rng.integers(0, top, n)
            c[rng.random(n) < 0.02] = (1 << 62) - 1
            data = patched.encode(c)
            assert patched.decode(data, n).tolist() == c.tolist()
            assert n == 0 or len(data) <= 3 * -(-n // 256) + sum(-(-len(x) * int(x.max()).bit_length() // 8) for x in (c[k : k + 256] for k in range(0, n, 256)))
    with pytest.raises(ValueError):
        patched.decode(patched.encode(np.arange(10)) + b"x", 10)
    k = keyed(spark, LISTS)
    for how in ({"epsilon": 63}, {"variant": "pfor"}):
        made = patched.compress(build(k, **how))
        assert sorted(map(tuple, codec.decode(patched.expand(made)).collect())) == sorted(map(tuple, k.collect()))
        assert {r.list_id: r.n for r in patched.bytes_of(made).groupBy("list_id").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {i: len(x) for i, x in enumerate(LISTS)}
