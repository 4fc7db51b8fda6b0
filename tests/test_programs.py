import json

import pytest

from gapline.__main__ import main
from gapline.sources import collections as c
from tests.test_index import keyed

LISTS = [list(range(0, 9000, 3)), list(range(0, 9000, 5)), [7, 15, 30, 8999]]


@pytest.mark.parametrize("how", [["--epsilon", "15"], ["--variant", "pfor"], ["--kind", "gap128"]])
def test_build_verify_decode_query(spark, tmp_path, capsys, how):
    c.write_docs(keyed(spark, LISTS), f"{tmp_path}/x.docs", 9000)
    (tmp_path / "x.queries").write_text("0 1\n2 2\n1 0 2 2\n")
    kind = how if how[0] == "--kind" else []
    index, docs = f"file://{tmp_path}/index", f"{tmp_path}/x.docs"
    n = sum(map(len, LISTS))
    built = main(["build", index, docs, *how])
    assert (built["n"], built["unequal"]) == (n, 0)
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == built
    assert main(["verify", index, docs, "--log", f"file://{tmp_path}/log", *[x for x in how if how[0] != "--epsilon"]])["unequal"] == 0
    assert main(["decode", index, *kind])["n"] == n
    a, b, d = map(set, LISTS)
    for op, want in (("AND", len(a & b) + len(a & b & d)), ("OR", len(a | b) + len(a | b | d))):
        got = main(["query", index, f"{tmp_path}/x.queries", op, "--out", f"file://{tmp_path}/out", *kind])
        assert (got["n_queries"], got["total_size"]) == (2, want)
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == want


def test_bad_input_is_refused(spark, tmp_path):
    c.write_docs(keyed(spark, [[5, 5]]), f"{tmp_path}/x.docs", 9)
    with pytest.raises(ValueError, match="order"):
        main(["build", f"file://{tmp_path}/i", f"{tmp_path}/x.docs"])
    c.write_docs(keyed(spark, [[5, 6]]), f"{tmp_path}/y.docs", 9)
    main(["build", f"file://{tmp_path}/i", f"{tmp_path}/y.docs"])
    (tmp_path / "q.queries").write_text("0 4\n")
    with pytest.raises(ValueError, match="lacks"):
        main(["query", f"file://{tmp_path}/i", f"{tmp_path}/q.queries", "OR"])
