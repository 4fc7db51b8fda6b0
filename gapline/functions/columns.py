"""Column expressions of the codec; whole numbers are BIGINT throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the cost model.
C = 0.109967
BASE_BITS = 1.957
SCALE = {"none": 136, "pfor": 27200}

PARAMETERS = ["covered", "delta_y", "delta_x", "y_b", "x_b"]  #: of a segment


def bit_width(x: Column) -> Column:
    """Bits of x >= 0; 0 has none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("bigint")


def bit_ceil(x: Column) -> Column:
    """The least power of two that is at least x >= 1."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_width(x - 1).cast("int"))


def fill_ones(x: Column) -> Column:
    """2 ** bit_width(x) - 1."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_width(x).cast("int")) - 1


def safe_log2(x: Column) -> Column:
    return F.log2(F.greatest(x, F.lit(2.2250738585072014e-308)))


def zigzag(x: Column) -> Column:
    return F.call_function("shiftleft", x, F.lit(1)).bitwiseXOR(F.call_function("shiftright", x, F.lit(63)))


def unzigzag(u: Column) -> Column:
    return F.call_function("shiftright", u, F.lit(1)).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("bigint"))))


def div(a: str, b: str) -> Column:
    """Whole division of SQL expressions that truncates towards zero."""
    return F.expr(f"({a}) div ({b})")


def line(pos: str = "pos") -> Column:
    """The value at pos of the line through (x_b, y_b) with slope delta_y / delta_x, rounded half away from zero."""
    d = f"({pos} - x_b)"
    return F.expr(f"(delta_y * {d} + (delta_x div 2) * cast(sign({d}) as bigint)) div delta_x + y_b")


def gap_variance(n: Column, total: Column, squares: Column) -> Column:
    """Unbiased variance of n gaps from their exact sums; 0 for fewer than two."""
    exact = (n.cast("decimal(10,0)") * squares.cast("decimal(27,0)") - total.cast("decimal(18,0)") * total.cast("decimal(18,0)")).cast("double")
    return F.when(n >= 2, F.greatest(F.lit(0.0), exact / (n * (n - 1)).cast("double"))).otherwise(F.lit(0.0))


def best_epsilon(n_keys: Column, variance: Column, scale: int) -> Column:
    """The error bound that the cost model prefers: all ones, at least 1."""
    g = (n_keys - 1).cast("double")
    e = F.ceil(F.sqrt(2 * F.log(F.lit(2.0)) * F.lit(C) * F.lit(float(scale)) * variance * g / (g + 1)))
    return F.when((n_keys < 2) | (variance <= 0), F.lit(1).cast("bigint")).otherwise(fill_ones(F.greatest(e, F.lit(1).cast("bigint"))))


def bit_cost(n_keys: Column, variance: Column, scale: int) -> Column:
    """Estimated bits of a range of keys."""
    per = F.greatest(F.lit(0.0), F.lit(BASE_BITS) + 0.5 * safe_log2(F.lit(C) * F.lit(float(scale)) * variance))
    return F.when((n_keys < 2) | (variance <= 0), F.lit(0.0)).otherwise((n_keys - 1) * per)


def words_bytes(count: Column, width: Column) -> Column:
    """Bytes of count values of width bits in 64-bit words."""
    return (F.ceil(count * width / 64) * 8).cast("bigint")


def doubles(text: Column, separator: str = ",") -> Column:
    """The numbers of a separated text, in order; parts that aren't numbers are left out."""
    parts = F.transform(F.split(text, F.lit(separator.replace("|", "\\|"))), lambda p: F.trim(p).try_cast("double"))
    return F.filter(parts, lambda x: x.isNotNull())
