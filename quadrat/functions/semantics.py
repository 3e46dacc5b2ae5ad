"""Missing values, division, spread and level order: the rules every operator shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division in which a zero denominator gives NULL instead of an error."""
    return F.try_divide(as_col(num), as_col(den))


def natural_log(c: str | Column) -> Column:
    """log(x); NULL for x <= 0, so that a non-null filter drops what would be -Inf."""
    x = as_col(c)
    return F.when(x > 0, F.log(x))


def shifted_log(c: str | Column, shift: float = 101.0) -> Column:
    """log1p(x + shift), which keeps changes down to -100 % in the domain."""
    return F.log1p(as_col(c) + F.lit(float(shift)))


def _strict(c: Column, stat: Column, na_rm: bool) -> Column:
    return stat if na_rm else F.when(F.count(c) == F.count(F.lit(1)), stat)


def mean_of(c: str | Column, na_rm: bool = False) -> Column:
    """Mean; a missing value makes the result missing unless ``na_rm``."""
    x = as_col(c)
    return _strict(x, F.avg(x), na_rm)


def sd_of(c: str | Column, na_rm: bool = False) -> Column:
    x = as_col(c)
    return _strict(x, F.stddev_samp(x), na_rm)


def se_of(c: str | Column, na_rm: bool = False) -> Column:
    """sqrt(variance / number of rows); the row count includes missing values, one row gives NULL."""
    x = as_col(c)
    return _strict(x, F.sqrt(F.var_samp(x) / F.count(F.lit(1))), na_rm)


def level_ordinal(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of a factor level in the given order; NULL for an unknown level."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.when(position > 0, position)


def reference_first(levels: Sequence[str], reference: str) -> list[str]:
    """The level order with the reference level moved to the front."""
    if reference not in levels:
        raise ValueError(f"{reference!r} is not one of {list(levels)}")
    return [reference, *[v for v in levels if v != reference]]


def same_keys(left, right, keys: Sequence[str]) -> Column:
    """NULL-safe equality on all keys, as a missing key is a group of its own."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
