"""Column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(num: Column, den: Column) -> Column:
    """Ratio as double; a zero denominator gives NULL, which means "no data"."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def guarded_div(num: Column, den: Column) -> Column:
    """Ratio whose denominator is at least 1, so an empty side gives 0 and not NULL."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(1.0))


def half_up(col: Column, digits: int = 0) -> Column:
    """Round half towards +infinity."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def r6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)


def sunday_week(ts: Column) -> Column:
    """First day (Sunday) of the week that holds ``ts``."""
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) - F.lit(1))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def any_of(cond: Column) -> Column:
    """Aggregate: did the condition hold on any row (NULL counts as no)."""
    return F.coalesce(F.bool_or(cond), F.lit(False))


def hash31(text: Column) -> Column:
    """Unsigned 32-bit polynomial hash (multiplier 31) over UTF-16 code units."""
    mod = F.lit(4294967296)

    def step(h: Column, ch: Column) -> Column:
        cp = F.ascii(ch).cast("long")
        off = cp - F.lit(65536)
        high = F.lit(55296) + F.floor(off / F.lit(1024)).cast("long")
        low = F.lit(56320) + off % F.lit(1024)
        return (
            F.when(cp < F.lit(65536), (h * 31 + cp) % mod)
            .otherwise((((h * 31 + high) % mod) * 31 + low) % mod)
        )

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def hash31_abs(text: Column) -> Column:
    """Absolute value of the same hash read as a signed 32-bit integer."""
    h = hash31(text)
    return F.when(h >= F.lit(2147483648), F.lit(4294967296) - h).otherwise(h)


# Coefficients of Acklam's rational approximation of the
# inverse standard normal distribution (published constants).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
_TAIL = 0.02425


def _horner(x: Column, coef) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coef[1:], F.lit(coef[0]))


def probit(p: Column) -> Column:
    """Inverse standard normal as a Column; +-infinity at and beyond the ends."""
    def tail(u: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.log(u))
        return _horner(q, _C) / (_horner(q, _D) * q + F.lit(1.0))

    mid = p - F.lit(0.5)
    r = mid * mid
    centre = _horner(r, _A) * mid / (_horner(r, _B) * r + F.lit(1.0))
    return (
        F.when(p <= 0, F.lit(float("-inf")))
        .when(p >= 1, F.lit(float("inf")))
        .when(p < _TAIL, tail(p))
        .when(p > 1 - _TAIL, -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """Nearest-rank percentile of a sorted array."""
    n = F.size(sorted_values)
    pos = F.greatest(F.ceil(n * F.lit(p)).cast("int"), F.lit(1))
    return F.try_element_at(sorted_values, pos)


def as_pct(v: Column) -> Column:
    return F.format_string("%.1f%%", v * 100)


def as_points(v: Column) -> Column:
    pts = v * 100
    return F.concat(F.when(pts >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.1f pts", pts))


def as_usd(v: Column) -> Column:
    return F.format_string("$%.2f", v)


def as_count(v: Column) -> Column:
    return F.floor(v + F.lit(0.5)).cast("string")


def short_sha(prefix: str, text: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def uuid_from(*parts: Column) -> Column:
    """Deterministic uuid-shaped id from the parts, so replays agree."""
    hexed = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws(
        "-",
        F.substring(hexed, 1, 8),
        F.substring(hexed, 9, 4),
        F.substring(hexed, 13, 4),
        F.substring(hexed, 17, 4),
        F.substring(hexed, 21, 12),
    )


def pinned(df, name: str, value: Column):
    """Add a column that is computed once per row.

    A plain column is a formula to the optimizer: a filter on it, or several
    uses of it, copy the formula. A one-row generator is a boundary for that,
    which matters for values as dear as a parsed document. The value is made
    before it: a generator in a stage too large to compile reads its argument
    expression by expression, a projection is compiled in parts.
    """
    made = f"_{name}_made"
    return df.select("*", value.alias(made)).select("*", F.explode_outer(F.array(made)).alias(name)).drop(made)
