import hashlib
import os
from collections import Counter

import pytest

from gapline.llm.warc import read_warc, round_trip, write_warc

SCHEMA = "page_id long, url string, html string, part string, first int"


def pages(spark):
    rows = [(i, f"http://x/{i}", f"page {i % 40} " * (30 if i % 3 else 1)) for i in range(200)]
    rows += [(900, None, None), (None, "a b\n", ""), (None, None, "z" * 100), (None, None, "z" * 100), (9, "u", "b" * 150), (9, "u", "b" * 150), (3, "v", "ä" * 99)]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)


def want(rows):
    key = lambda r: (1 << 63 if r.page_id is None else r.page_id, hashlib.sha256((r.html or "").encode()).hexdigest())
    low, seen, out = {}, set(), Counter()
    for r in rows:
        if len((r.html or "").encode()) >= 100:
            low[key(r)[1]] = min(low.get(key(r)[1], 1 << 64), key(r)[0])
    for r in rows:
        k, h = key(r)
        again = h in low and (k != low[h] or (k, h) in seen)
        seen.add((k, h))
        out[r.page_id, len((r.html or "").encode()), h, "revisit" if again else "response", low[h] if again and low[h] < 1 << 63 else None] += 1
    return out


def test_round_trip(spark, tmp_path):
    df = pages(spark)
    out = round_trip(df, f"file://{tmp_path}/w", part_bytes=4000, roll_bytes=600)
    assert Counter(map(tuple, out.collect())) == want(df.collect())
    assert round_trip(df.limit(0)).count() == 0


def test_files_do_not_depend_on_layout(spark, tmp_path):
    df = pages(spark).where("page_id is not null")
    a = write_warc(df, f"file://{tmp_path}/a", part_bytes=4000, roll_bytes=600)
    b = write_warc(df.repartition(7), f"file://{tmp_path}/b", part_bytes=4000, roll_bytes=600)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 5
    assert not os.path.exists(f"{tmp_path}/a/_temporary")


def test_a_changed_file_is_noticed_and_strays_are_not_read(spark, tmp_path):
    write_warc(pages(spark), f"file://{tmp_path}/w")
    n = read_warc(spark, f"file://{tmp_path}/w").count()
    (tmp_path / "w" / "part-000009-000000.warc.gz").write_bytes(b"left by a lost attempt")
    assert read_warc(spark, f"file://{tmp_path}/w").count() == n
    whole = next((tmp_path / "w").glob("part-000000-*.gz"))
    whole.write_bytes(whole.read_bytes()[:-40])
    with pytest.raises(Exception):  # noqa: B017
        read_warc(spark, f"file://{tmp_path}/w").collect()


def test_very_long_payloads_and_few_parts(spark, tmp_path):
    long = "ä" * 3_000_000
    df = spark.createDataFrame([(i, "u", long if i % 3 else f"{long}{i % 2}") for i in range(8)], "page_id long, url string, html string")
    out = round_trip(df, f"file://{tmp_path}/w", part_bytes=1 << 20, most_parts=2)
    assert Counter(map(tuple, out.collect())) == want(df.collect())
