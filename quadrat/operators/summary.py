"""Group summaries. All are partial + final aggregates; order statistics go through ``rank_cells``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.grouping import HOT_ROWS, attach, exact_quantiles, keyed_join, rank_cells, with_group_stats
from quadrat.functions.semantics import mean_of, ratio, sd_of, se_of


def _rounded(c, digits):
    return c if digits is None else F.round(c, digits)


def mean_se(df: DataFrame, by: Sequence[str], values: dict[str, str], na_rm: bool = False, digits: int | None = None) -> DataFrame:
    """Mean and standard error per group; ``values`` maps a column to the suffix of its two results."""
    aggs = []
    for column, suffix in values.items():
        aggs += [_rounded(mean_of(column, na_rm), digits).alias(f"mean{suffix}"),
                 _rounded(se_of(column, na_rm), digits).alias(f"se{suffix}")]
    return df.groupBy(*by).agg(*aggs)


def mean_sd(df: DataFrame, by: Sequence[str], value: str, na_rm: bool = False) -> DataFrame:
    return df.groupBy(*by).agg(mean_of(value, na_rm).alias("mean"), sd_of(value, na_rm).alias("sd"))


def median_iqr(df: DataFrame, by: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    q = exact_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, hot_rows)
    return q.select(*by, "median", (F.col("q3") - F.col("q1")).alias("iqr"))


def box_summary(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Five numbers, whisker ends (the extreme values within ``reach`` IQR of the box) and number of outliers."""
    q = exact_quantiles(df, by, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, hot_rows)
    fenced = _within_fences(df, by, value, q, reach)
    ends = fenced.groupBy(*by).agg(
        F.min(F.when(F.col("_in"), F.col(value))).alias("whisker_low"),
        F.max(F.when(F.col("_in"), F.col(value))).alias("whisker_high"),
        F.count_if(~F.col("_in")).alias("outliers"))
    return keyed_join(q, ends, by, "inner")


def box_outliers(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows beyond the whiskers."""
    q = exact_quantiles(df, by, value, {"q1": 0.25, "q3": 0.75}, hot_rows)
    return _within_fences(df, by, value, q, reach).filter(~F.col("_in")).select(df.columns)


def _within_fences(df, by, value, q, reach):
    width = F.lit(reach) * (F.col("q3") - F.col("q1"))
    fences = q.select(*by, (F.col("q1") - width).alias("_low"), (F.col("q3") + width).alias("_high"))
    rows = attach(df.filter(F.col(value).isNotNull()), fences, by, "inner")
    return rows.withColumn("_in", F.col(value).between(F.col("_low"), F.col("_high")))


def histogram(df: DataFrame, by: Sequence[str], value: str, width: float) -> DataFrame:
    """Counts in bins of a fixed width, a bin being centred on each multiple of it."""
    # The default of the plotting convention followed here is that the bins are centred, closed on the right.
    number = F.ceil((F.col(value) / F.lit(float(width))) - F.lit(0.5))
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*by, (number * F.lit(float(width)) + F.lit(0.0)).alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def histogram_bins(df: DataFrame, by: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` bins per group, closed on the right; the first is centred on the smallest value and the last on the largest.

    Empty bins have no row. A group whose values are all equal has one bin that begins and ends at this value.
    """
    if bins < 2:
        raise ValueError("a number of bins is 2 at least")
    present = with_group_stats(df.filter(F.col(value).isNotNull()), by, [F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi")])
    width = (F.col("_hi") - F.col("_lo")) / (bins - 1)
    number = F.least(F.greatest(F.ceil(ratio(F.col(value) - F.col("_lo"), "_w") + 0.5) - 1, F.lit(0)), F.lit(bins - 1))
    placed = present.withColumn("_w", width).withColumn("_i", F.coalesce(number, F.lit(0)).cast("int"))
    low = F.col("_lo") + (F.col("_i") - 0.5) * F.col("_w")
    return placed.groupBy(*by, low.alias("bin_low"), (low + F.col("_w")).alias("bin_high")).agg(F.count(F.lit(1)).alias("n"))


def histogram_sturges(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts in round-width bins, about ``log2(n) + 1`` of them, closed on the right as is usual for this rule.

    A group whose values are all equal has one bin that begins and ends at this value.
    """
    classes = F.ceil(F.log2("_n") + 1)
    stats = [F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    raw = (F.col("_hi") - F.col("_lo")) / F.col("_k")
    base = F.pow(F.lit(10.0), F.floor(F.log10("_raw")))
    # A width is rounded to 1, 2, 5 or 10 times a power of ten at these switch points.
    step = F.col("_raw") / F.col("_base")
    nice = (F.when(step < 1.4, 1.0).when(step < 2.8, 2.0)
            .when(step < 7.0, 5.0).otherwise(10.0))
    binned = (
        with_group_stats(df.filter(F.col(value).isNotNull()), by, stats)
        .withColumn("_k", classes).withColumn("_raw", raw)
        .withColumn("_base", F.when(F.col("_raw") > 0, base)).withColumn("_w", F.when(F.col("_raw") > 0, nice * F.col("_base")))
        .withColumn("_lowest", F.floor(F.col("_lo") / F.col("_w")))
        .withColumn("_i", F.greatest(F.ceil(F.col(value) / F.col("_w")) - 1, F.col("_lowest"))))
    low, high = F.col("_i") * F.col("_w"), (F.col("_i") + 1) * F.col("_w")
    return binned.groupBy(*by, F.coalesce(low, F.col("_lo").cast("double")).alias("bin_low"),
                          F.coalesce(high, F.col("_hi").cast("double")).alias("bin_high")).agg(F.count(F.lit(1)).alias("n"))


def group_max_ranked(df: DataFrame, by: Sequence[str], value: str, name: str = "max_value") -> DataFrame:
    """Largest value per group, largest first."""
    return df.groupBy(*by).agg(F.max(value).alias(name)).orderBy(F.desc(name), *by)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "avg_rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row with the average rank of its value inside the group; NULL values keep a NULL rank."""
    cells = rank_cells(df, by, value, hot_rows=hot_rows)
    ranks = cells.select(*by, value, (F.col("before") + (F.col("ties") + 1) / 2).alias(name))
    return attach(df, ranks, [*by, value])


def share_of_total(df: DataFrame, by: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Value divided by the total of its group."""
    rows = with_group_stats(df, by, [F.sum(value).alias("_total")])
    return rows.withColumn(name, ratio(value, "_total")).drop("_total")


def share_of_max(df: DataFrame, by: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Value divided by the largest value of its group."""
    rows = with_group_stats(df, by, [F.max(value).alias("_max")])
    return rows.withColumn(name, ratio(value, "_max")).drop("_max")
