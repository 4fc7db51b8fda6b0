import itertools
from collections import Counter
from fractions import Fraction

from gapline.llm.mixing import capped_targets, min_cost_flow, mix, mixed_documents
from tests.llm.fixtures import documents, empty


def test_targets_stop_at_the_cap_and_the_excess_is_dealt_again():
    t = capped_targets([100, 100, 100], [3, 1, 2], Fraction("1.5"), 2)
    assert t == [200, Fraction(250, 3), Fraction(500, 3)] and sum(t) == 450
    assert capped_targets([0, 10], [3, 1], Fraction("1.5"), 2) == [0, 15] and capped_targets([], [], Fraction(1), 2) == []


def test_flow_is_of_least_cost():
    capacity = {("a",): [(4, 0), (4, 1)], ("a", "b"): [(3, 0), (3, 1)], ("b",): [(2, 0), (2, 1)]}
    quota = {"a": 5, "b": 6}
    flow = min_cost_flow(capacity, quota, {p: list(p) for p in capacity})
    cost = lambda f: sum(max(0, f[p] - c[0][0]) for p, c in capacity.items())
    best = None
    for a, ab, b in itertools.product(range(9), range(7), range(5)):
        for x in range(ab + 1):
            if a + x == 5 and ab - x + b == 6:
                c = cost({("a",): a, ("a", "b"): ab, ("b",): b})
                best = c if best is None else min(best, c)
    assert sum(flow.values()) == 11 and cost(flow) == best


def test_each_source_comes_near_its_target(spark):
    docs = documents(spark, n=400)
    out = mix(docs).collect()
    assert len(out) == docs.count() and sorted(map(tuple, out), key=repr) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=repr)
    source = [r.source for r in docs.collect()]
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        key = (r.source_size, r.target)
        taken[key] += r.taken
        size[key] += r.size
        target[key] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    assert len(target) == len(set(source)) and all(k[0] == n for k, n in size.items())
    for k, t in target.items():  # no document that fits what is left has been passed over
        own = [r for r in out if (r.source_size, r.target) == k and r.size]
        base = min((r.copies for r in own), default=0)
        spare = [r.size for r in own if r.copies == base]
        step = max(r.size for r in own) if len(spare) == len(own) or taken[k] > t else min(spare)
        assert abs(taken[k] - t) <= max(0.002 * t, 1, step)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6


def test_overlapping_sources_rows_and_empty_tables(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "array(source, 's1') as source")
    out = mix(docs).collect()
    assert len(out) == docs.count()
    many = mixed_documents(documents(spark))
    assert many.columns == documents(spark).columns
    assert many.count() == sum(r.copies for r in mix(documents(spark)).collect())
    assert mix(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0
