"""Scalar and array column functions used across the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col, digits: int) -> Column:
    """Rounding for display; exact ties go to the even digit."""
    return F.bround(col, digits)


def number_text(col) -> Column:
    """A number as text without a trailing ``.0``: 1, 0.9."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def interval_text(lo, hi) -> Column:
    """``[lo, hi]`` as text."""
    return F.concat(F.lit("["), number_text(lo), F.lit(", "), number_text(hi), F.lit("]"))


def labelled_counts(pairs: Sequence[tuple[str, Column]]) -> Column:
    """``a = 1, b = 2`` as text from (label, number) pairs."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k} = "), number_text(v)) for k, v in pairs])


def indicator(condition: Column) -> Column:
    """1 or 0 from a predicate; an unknown predicate stays null."""
    return condition.cast("int")


def is_in(col, values) -> Column:
    """Membership that is false, never null, for a null value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(list(values)), F.lit(False))


def zero_if_null(col) -> Column:
    return F.coalesce(col, F.lit(0.0))


def recycle(values: Sequence[float], width: int) -> list[float]:
    """A scalar or short vector repeated to ``width``, as vector recycling does."""
    vals = list(values)
    return [float(vals[i % len(vals)]) for i in range(width)]


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def add_all(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def dot(a, b) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def matched(col, pattern: str) -> Column:
    """Regular expression search in a name."""
    return (F.col(col) if isinstance(col, str) else col).rlike(pattern)


# Coefficients of Acklam's rational approximation of the normal quantile, highest power first.
QUANTILE_MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690,
                    -30.66479806614716, 2.506628277459239),
                   (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972,
                    -13.28068155288572, 1.0))
QUANTILE_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734,
                  4.374664141464968, 2.938163982698783),
                 (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
QUANTILE_TAIL_BELOW = 0.02425


def normal_quantile_column(p: Column) -> Column:
    """Standard normal quantile of a column of probabilities in (0, 1), to a relative error near 1e-9."""
    def poly(coefficients, x):
        return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))

    q = p - 0.5
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    far = poly(QUANTILE_TAIL[0], tail) / poly(QUANTILE_TAIL[1], tail)
    near = q * poly(QUANTILE_MIDDLE[0], q * q) / poly(QUANTILE_MIDDLE[1], q * q)
    return F.when(p < QUANTILE_TAIL_BELOW, far).when(p > 1 - QUANTILE_TAIL_BELOW, -far).otherwise(near)


def normal_quantile(p: float) -> float:
    """Standard normal quantile, for example 1.959964 at 0.975."""
    return NormalDist().inv_cdf(p)
