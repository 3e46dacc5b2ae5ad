"""Grouped tests: one result row per group, from aggregates and ranks only."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quadrat.functions.grouping import HOT_ROWS, attach, exact_quantiles, rank_cells, with_group_stats
from quadrat.functions.semantics import ratio
from quadrat.functions.tails import (normal_quantile, p_chi2, p_two_sided_t, p_upper_normal, q_two_sided_t, rank_sum_p)

SHAPIRO_ROWS = (3, 5000)  # the approximation is defined for these sample sizes only

# Royston's polynomials for the Shapiro-Wilk test, Applied Statistics 44 (1995), lowest power first.
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_LAST_BUT_ONE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_SHIFT = (-2.273, 0.459)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def _copies(cells: DataFrame) -> DataFrame:
    """One row per observation of ``rank_cells`` with ``_i``, its place in the group; copies of one value in chunks, never as
    one long array."""
    chunk = 10_000
    starts = cells.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("ties") - 1, F.lit(chunk))))
    return starts.withColumn("_k", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + chunk, F.col("ties")) - 1))).withColumn(
        "_i", F.col("before") + F.col("_k") + 1)


def shapiro(df: DataFrame, by: Sequence[str], x: str, p_value: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Shapiro-Wilk W of groups of any size from 3 rows, and p, whose approximation is defined up to 5000 rows.

    Groups of fewer rows or without spread get NULL. Places come from value ranges, so no group is sorted in one task; the
    order statistic of a place is the value whose copies span it.
    """
    low, high = SHAPIRO_ROWS
    cells = rank_cells(df, by, x, hot_rows=hot_rows)
    scored = _copies(cells).withColumn("_p", (F.col("_i") - 0.375) / (F.col("size") + 0.25)).withColumn("_m", normal_quantile("_p"))

    def at(i: Column) -> Column:
        return F.max(F.when(F.col("_i") == i, F.col(x)))

    size = F.col("size")
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.var_samp(x).alias("_v"), F.sum(F.col("_m") * F.col(x)).alias("_mx"), F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        (at(size) - at(F.lit(1))).alias("_outer"), (at(size - 1) - at(F.lit(2))).alias("_second"))
    sums = sums.withColumns({"_pn": (F.col("_n") - 0.375) / (F.col("_n") + 0.25), "_po": F.greatest(F.col("_n") - 1.375, F.lit(0.1)) / (F.col("_n") + 0.25)})
    sums = sums.withColumns({"_mn": normal_quantile("_pn"), "_mo": normal_quantile("_po")})
    u = 1 / F.sqrt("_n")
    root = F.sqrt("_mm")
    wide = sums.withColumns({"_an": ratio("_mn", root) + _poly(_LAST, u),
                             "_ao": ratio("_mo", root) + _poly(_LAST_BUT_ONE, u)})
    two = (F.col("_n") > 5)
    phi = F.when(two, (F.col("_mm") - 2 * F.col("_mn") ** 2 - 2 * F.col("_mo") ** 2)
                 / (1 - 2 * F.col("_an") ** 2 - 2 * F.col("_ao") ** 2)).otherwise(
        (F.col("_mm") - 2 * F.col("_mn") ** 2) / (1 - 2 * F.col("_an") ** 2))
    ends = F.col("_mn") * F.col("_outer")
    inner = F.when(two, F.col("_mx") - ends - F.col("_mo") * F.col("_second")).otherwise(F.col("_mx") - ends)
    line = F.when(F.col("_n") == 3, F.lit(math.sqrt(0.5)) * F.col("_outer")).otherwise(
        ratio(inner, F.sqrt(phi)) + F.col("_an") * F.col("_outer")
        + F.when(two, F.col("_ao") * F.col("_second")).otherwise(F.lit(0.0)))
    w = F.least(line ** 2 / ((F.col("_n") - 1) * F.col("_v")), F.lit(1.0))
    out = wide.select(*by, F.col("_n").alias("n"), F.when((F.col("_n") >= low) & (F.col("_v") > 0), w).alias("w"))
    return _shapiro_p(out, high) if p_value else out


def _shapiro_p(df: DataFrame, most_rows: int) -> DataFrame:
    n, w = F.col("n").cast("double"), F.col("w")
    small = (-F.log(_poly(_SMALL_SHIFT, n) - F.log(1 - w)) - _poly(_SMALL_MEAN, n)) / F.exp(_poly(_SMALL_LOG_SD, n))
    logn = F.log(n)
    large = (F.log(1 - w) - _poly(_LARGE_MEAN, logn)) / F.exp(_poly(_LARGE_LOG_SD, logn))
    three = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt(w)) - F.lit(math.asin(math.sqrt(0.75)))), F.lit(0.0))
    z = F.when(w < 1, F.when(n <= 11, small).otherwise(large))
    return (df.withColumn("_z", z).withColumn("_p", p_upper_normal("_z"))
            .withColumn("p", F.when(n == 3, three).when(n > most_rows, F.lit(None)).when(w == 1, F.lit(1.0)).otherwise(F.col("_p"))).drop("_z", "_p"))


def qq_points(df: DataFrame, by: Sequence[str], x: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each observation with the normal quantile of its place in the group."""
    cells = rank_cells(df, by, x, hot_rows=hot_rows)
    a = F.when(F.col("size") <= 10, 0.375).otherwise(0.5)
    p = (F.col("_i") - a) / (F.col("size") + 1 - 2 * a)
    return (_copies(cells).withColumn("_p", p)
            .select(*by, normal_quantile("_p").alias("theoretical"), F.col(x).alias("sample")))


def qq_line(df: DataFrame, by: Sequence[str], x: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Line through the first and third quartiles of sample and normal distribution."""
    q = exact_quantiles(df, by, x, {"q1": 0.25, "q3": 0.75}, hot_rows).withColumn("_p", F.lit(0.75))
    slope = (F.col("q3") - F.col("q1")) / (2 * normal_quantile("_p"))
    return q.select(*by, slope.alias("slope"), ((F.col("q1") + F.col("q3")) / 2).alias("intercept"))


def t_test_welch(df: DataFrame, by: Sequence[str], group: str, levels: Sequence[str], x: str, p_value: bool = True) -> DataFrame:
    """Two-sample t test without equal variances; ``levels`` names the two groups in order."""
    aggs = []
    for i, level in enumerate(levels[:2], 1):
        v = F.when(F.col(group) == level, F.col(x))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), (F.var_samp(v) / F.count(v)).alias(f"_s{i}")]
    out = df.filter(F.col(group).isin(list(levels[:2]))).groupBy(*by).agg(*aggs)
    s = F.col("_s1") + F.col("_s2")
    out = out.withColumns({
        "t": ratio(F.col("mean1") - F.col("mean2"), F.sqrt(s)),
        "df": ratio(s * s, F.try_divide(F.col("_s1") ** 2, F.col("n1") - 1) + F.try_divide(F.col("_s2") ** 2, F.col("n2") - 1))})
    out = out.drop("_s1", "_s2")
    return out.withColumn("p", p_two_sided_t("t", "df")) if p_value else out


def _cube(t: Column) -> Column:
    d = t.cast("double")
    return d * d * d - d


def wilcoxon_rank_sum(df: DataFrame, by: Sequence[str], group: str, levels: Sequence[str], x: str,
                      exact: bool | None = None, p_value: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank-sum statistic W of the first level. ``exact=None`` is exact for both sizes below 50 without ties; ``method`` tells
    how p was found."""
    first, second = levels[:2]
    cells = rank_cells(df.filter(F.col(group).isin([first, second])), by, x,
                       [F.count_if(F.col(group) == first).alias("_a")], hot_rows)
    rank = F.col("before") + (F.col("ties") + 1) / 2
    out = cells.groupBy(*by).agg(
        F.sum("_a").alias("n1"), (F.max("size") - F.sum("_a")).alias("n2"),
        (F.sum(F.col("_a") * rank) - F.sum("_a") * (F.sum("_a") + 1) / 2).alias("w"),
        F.sum(_cube(F.col("ties"))).alias("tie_term"))
    if not p_value:
        return out

    @F.pandas_udf(DoubleType())
    def p_of(w: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series, counted: pd.Series) -> pd.Series:
        found = rank_sum_p(w, m, n, ties, counted.to_numpy(bool))
        return pd.Series(pd.array(np.where(np.isnan(found), 0.0, found), "Float64")).mask(np.isnan(found))

    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    counted = both & ((F.col("n1") < 50) & (F.col("n2") < 50) & (F.col("tie_term") == 0) if exact is None else F.lit(exact))
    out = out.withColumn("method", F.when(both, F.when(counted, "exact").otherwise("normal")))
    return out.withColumn("p", p_of("w", "n1", "n2", "tie_term", counted))


def kruskal_wallis(df: DataFrame, by: Sequence[str], group: str, levels: Sequence[str], x: str,
                   p_value: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """H with tie correction over the given levels, its degrees of freedom and p."""
    carry = [F.count_if(F.col(group) == v).alias(f"_c{i}") for i, v in enumerate(levels)]
    cells = rank_cells(df.filter(F.col(group).isin(list(levels))), by, x, carry, hot_rows)
    rank = F.col("before") + (F.col("ties") + 1) / 2
    aggs = [F.max("size").alias("n"), F.sum(_cube(F.col("ties"))).alias("_t")]
    for i, _ in enumerate(levels):
        aggs += [F.sum(F.col(f"_c{i}") * rank).alias(f"_r{i}"), F.sum(f"_c{i}").alias(f"_n{i}")]
    s = cells.groupBy(*by).agg(*aggs)
    parts = [F.coalesce(ratio(F.col(f"_r{i}") * F.col(f"_r{i}"), f"_n{i}"), F.lit(0.0)) for i, _ in enumerate(levels)]
    used = sum((F.when(F.col(f"_n{i}") > 0, 1).otherwise(0) for i, _ in enumerate(levels[1:], 1)),
               F.when(F.col("_n0") > 0, 1).otherwise(0))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * sum(parts[1:], parts[0]) - 3 * (n + 1)
    out = s.select(*by, "n", ratio(raw, 1 - F.try_divide(F.col("_t"), n * n * n - n)).alias("h"), (used - 1).alias("df"))
    return out.withColumn("p", p_chi2("h", F.col("df").cast("double"))) if p_value else out


def simple_regression(df: DataFrame, by: Sequence[str], x: str, y: str, p_value: bool = True) -> DataFrame:
    """Slope, intercept, R^2 and the t test of the slope."""
    s = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"), F.regr_avgx(y, x).alias("_mx"))
    df_res = F.col("n") - 2
    s2 = F.try_divide(F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0)), df_res)
    out = s.withColumn("_s2", s2).withColumn("t", ratio("slope", F.sqrt(ratio("_s2", "_sxx"))))
    if p_value:
        out = out.withColumn("p", p_two_sided_t("t", df_res.cast("double")))
    return out.drop("_sxx", "_syy", "_sxy", "_mx", "_s2")


def regression_band(df: DataFrame, by: Sequence[str], x: str, y: str, points: int = 80, level: float = 0.95) -> DataFrame:
    """Fitted line with its confidence band on a grid over the range of x."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.avg(x).alias("_mx"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).filter((F.col("_n") > 2) & (F.col("_sxx") > 0))
    s = s.withColumn("_t", q_two_sided_t(F.lit(1 - level), (F.col("_n") - 2).cast("double")))
    grid = s.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / (points - 1))
    fit = F.col("_a") + F.col("_b") * F.col("x")
    s2 = F.greatest(F.col("_syy") - F.col("_b") * F.col("_sxy"), F.lit(0.0)) / (F.col("_n") - 2)
    half = F.col("_t") * F.sqrt(s2 * (1 / F.col("_n") + (F.col("x") - F.col("_mx")) ** 2 / F.col("_sxx")))
    return grid.select(*by, "x", fit.alias("fit"), (fit - half).alias("lower"), (fit + half).alias("upper"))


def significance_flag(df: DataFrame, p: str = "p", alpha: float = 0.05, name: str = "significant") -> DataFrame:
    """``sig`` / ``not sig`` by p <= alpha; a missing p gives NULL."""
    return df.withColumn(name, F.when(F.col(p) <= alpha, "sig").when(F.col(p) > alpha, "not sig"))


def p_adjust(df: DataFrame, by: Sequence[str], p: str = "p", method: str = "BH", name: str = "padj",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adjust p values inside each group: ``BH``, ``bonferroni`` or ``none``. Missing p values are not counted."""
    if method == "none":
        return df.withColumn(name, F.col(p))
    if method == "bonferroni":
        rows = with_group_stats(df, by, [F.count(p).alias("_m")])
        return rows.withColumn(name, F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")
    if method != "BH":
        raise ValueError(f"unknown method {method!r}")
    cells = rank_cells(df, by, p, hot_rows=hot_rows).withColumn(
        "_raw", F.col(p) * F.col("size") / (F.col("before") + F.col("ties")))
    # The smallest value from here to the end of the group: inside the value range, then over the later ranges.
    ahead = Window.partitionBy(*by, "_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = cells.groupBy(*by, "_range").agg(F.min("_raw").alias("_low")).withColumn("_later", F.min("_low").over(later))
    inside = cells.withColumn("_low_here", F.min("_raw").over(ahead))
    both = attach(inside, ranges.drop("_low"), [*by, "_range"])
    adjusted = both.select(*by, p, F.least("_low_here", "_later", F.lit(1.0)).alias(name))
    return attach(df, adjusted, [*by, p])
