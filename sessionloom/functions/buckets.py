"""Numeric bands as text."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from sessionloom.functions.text import word_count


def _number(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def _chain(x: Column, cuts, prefix: str, names=None) -> Column:
    names = names or [str(c) for c in cuts]
    out = None
    for cut, name in zip(cuts, names):
        test = x <= F.lit(float(cut))
        out = F.when(test, f"{prefix}_{name}") if out is None else out.when(test, f"{prefix}_{name}")
    return out.otherwise(f"gt_{names[-1]}")


def band(value: Column, cuts, prefix: str = "le") -> Column:
    """Truncate to an integer, then le_<cut> / gt_<last>; 'na' when it is no finite number."""
    x = _number(value)
    return F.when(_finite(x), _chain(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), cuts, prefix)).otherwise("na")


def band_float(value: Column, cuts, prefix: str = "le", missing: str = "na") -> Column:
    """Compare without truncation. NaN is no smaller than any cut."""
    x = _number(value)
    return F.when(x.isNull(), missing).when(F.isnan(x), f"gt_{cuts[-1]}").otherwise(_chain(x, cuts, prefix))


def band_unknown(value: Column, cuts) -> Column:
    """Compare as numbers; 'unknown' when missing; dots in names become underscores."""
    x = _number(value)
    names = [str(c).replace(".", "_") for c in cuts]
    return F.when(x.isNull() | F.isnan(x), "unknown").otherwise(_chain(x, cuts, "le", names))


def bin_floor(value: Column, size: int) -> Column:
    """Number of the fixed-width bin, 'na' when it is no finite number."""
    x = _number(value)
    return F.when(_finite(x), F.floor(x / F.lit(float(size))).cast("string")).otherwise("na")


def turn_phase(value: Column) -> Column:
    x = _number(value)
    t = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return (
        F.when(~_finite(x) | x.isNull(), "na")
        .when(t <= 2, "early")
        .when(t <= 6, "mid")
        .when(t <= 12, "late")
        .otherwise("deep")
    )


def budget_critical(value: Column, limit: int = 5000) -> Column:
    """1 below the limit, else 0 (also when missing)."""
    return F.when(_number(value) < limit, 1).otherwise(0)


def count_band(n: Column) -> Column:
    return (
        F.when(n <= 0, "0")
        .when(n == 1, "1")
        .when(n == 2, "2")
        .when(n <= 4, "3_4")
        .when(n <= 8, "5_8")
        .otherwise("gt_8")
    )


def prompt_band(prompt: Column) -> Column:
    n = word_count(prompt)
    return (
        F.when(n <= 5, "le5").when(n <= 10, "le10").when(n <= 18, "le18").when(n <= 30, "le30").otherwise("gt30")
    )


def budget_band(budget: Column) -> Column:
    return band(budget, [5000, 12000, 20000])


def scaled_log(x: Column, divisor: float) -> Column:
    """log1p(x) / divisor, not clipped."""
    return F.log1p(x.cast("double")) / F.lit(float(divisor))


def scaled_log_clipped(value: Column, divisor: float) -> Column:
    """min(1, log1p(max(x, 0)) / divisor); no number counts as 0."""
    x = _number(value)
    x = F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).otherwise(x)
    return F.least(F.lit(1.0), F.log1p(x) / F.lit(float(divisor)))
