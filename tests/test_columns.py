from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapline.functions.columns import best_epsilon, bit_ceil, bit_cost, bit_width, div, fill_ones, safe_log2, unzigzag, words_bytes, zigzag
from gapline.operators import fit


def test_whole_number_functions(spark):
    xs = [0, 1, 2, 3, 4, 7, 8, 1023, 1024, (1 << 31) - 1, 1 << 40]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for r in df.select("x", bit_width(F.col("x")).alias("w"), fill_ones(F.col("x")).alias("f"), zigzag(F.col("x")).alias("z"), zigzag(-F.col("x")).alias("y"), unzigzag(zigzag(-F.col("x"))).alias("b")).collect():
        assert (r.w, r.f, r.z, r.y, r.b) == (r.x.bit_length(), (1 << r.x.bit_length()) - 1, 2 * r.x, 2 * r.x - 1 if r.x else 0, -r.x)
    assert [r[0] for r in df.where("x > 0").select(bit_ceil(F.col("x"))).collect()] == [1 << (x - 1).bit_length() for x in xs if x]
    assert spark.range(1).select(div("-7", "2"), div("7", "2"), safe_log2(F.lit(0.0)), words_bytes(F.lit(3), F.lit(22))).first()[:2] == (-3, 3)


def test_cost_model_guards(spark):
    n, v = F.col("n"), F.col("v")
    df = spark.createDataFrame([(1, 5.0), (10, 0.0), (10, 1e-9), (1024, 1e4)], "n long, v double")
    got = df.select(best_epsilon(n, v, 136).alias("e"), bit_cost(n, v, 136).alias("c")).collect()
    assert [r.e for r in got][:3] == [1, 1, 1] and got[3].e & (got[3].e + 1) == 0 and [r.c for r in got][:3] == [0, 0, 0] and got[3].c > 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, (1 << 31) - 2), min_size=1, max_size=200), st.sampled_from([1, 3, 15, 63, 1023, 262143]))
def test_segments_are_lossless_and_bounded(ids, epsilon):
    keys = np.array(sorted(ids))
    at = 0
    for first, covered, dy, dx, yb, xb in zip(*fit.cut(keys, np.full(len(keys), epsilon), np.array([len(keys)])), strict=True):
        assert first == at and dx > 0 and first <= xb < first + covered
        r = keys[at : at + covered] - fit.approximate(np.arange(first, first + covered), dy, dx, yb, xb)
        assert np.abs(r).max() <= epsilon
        at += covered
    assert at == len(keys)


def plain_cut(keys, epsilon):
    """Segments by all pairs, in fractions: the longest run whose bounds agree, and its steepest line."""
    lo, hi = [max(k - epsilon, 0) for k in keys], [min(k + epsilon, fit.TOP) for k in keys]
    out, at = [], 0
    while at < len(keys):
        up, low, pair, n = None, None, None, 1
        for i in range(at + 1, len(keys)):
            for j in range(i - 1, at - 1, -1):
                bound = Fraction(hi[i] - lo[j], i - j)
                if up is None or bound < up:
                    up, now = bound, (j, i)
                low = max(low, Fraction(lo[i] - hi[j], i - j)) if low is not None else Fraction(lo[i] - hi[j], i - j)
            if low > up:
                break
            pair, n = now, n + 1
        out.append((at, n, hi[pair[1]] - lo[pair[0]], pair[1] - pair[0], lo[pair[0]], pair[0]) if n > 1 else (at, 1, 0, 1, keys[at], at))
        at += n
    return out


@pytest.mark.parametrize("near, block, middle", [(fit.NEAR, fit.BLOCK, fit.MIDDLE), (4, 7, 20), (2, 3, 0)])
def test_segments_match_all_pairs(monkeypatch, near, block, middle):
    for name, value in (("NEAR", near), ("BLOCK", block), ("MIDDLE", middle)):
        monkeypatch.setattr(fit, name, value)
    rng = np.random.default_rng(4)
    units = [np.cumsum(rng.integers(1, g + 1, n)) for g in (1, 2, 5, 50, 1000) for n in (1, 2, 3, 33, 120)]
    units += [np.arange(90) ** 2, np.sqrt(np.arange(1, 90) * 1e6).astype(int), np.r_[0, fit.TOP - 1], fit.TOP - 1 - np.arange(60)[::-1] * 2]
    for epsilon in (1, 3, 15, 255):
        want, base = [], 0
        for u in units:
            want += [(f + base, n, dy, dx, yb, xb + base) for f, n, dy, dx, yb, xb in plain_cut(u.tolist(), epsilon)]
            base += len(u)
        keys = np.concatenate(units)
        got = fit.cut(keys, np.full(len(keys), epsilon), np.cumsum([len(u) for u in units]))
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
