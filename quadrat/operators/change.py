"""Repeated measures: change against the baseline of the same unit, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.grouping import with_group_stats
from quadrat.functions.semantics import natural_log, ratio, se_of

EPSILON = 1e-6


def percent_change(df: DataFrame, units: Sequence[str], time: str, levels: Sequence[str], baseline: str,
                   values: Sequence[str], epsilon: float = EPSILON, label: str = "diffTimeSeries") -> DataFrame:
    """Percent change of every value column from the baseline time of the same unit.

    The baseline is shifted by ``epsilon`` in both places, ``(x - (x0 + e)) / (x0 + e) * 100``, so a zero baseline
    gives a large finite number. Baseline rows drop out; the time column becomes ``label`` = ``diff_<level>``.
    A unit without a baseline keeps its rows with NULL change. All columns are handled in one pass: the baselines
    are a map-side combined aggregate of the unit, joined back to its later rows.
    """
    wanted = df.filter(F.col(time).isin(list(levels)))
    base = [F.avg(F.when(F.col(time) == baseline, F.col(v))).alias(f"_base_{v}") for v in values]
    joined = with_group_stats(wanted, units, base).filter(F.col(time) != baseline)
    out = {}
    for v in values:
        shifted = F.col(f"_base_{v}") + F.lit(epsilon)
        out[v] = ratio(F.col(v) - shifted, shifted) * 100
    return (joined.withColumns(out)
            .withColumn(label, F.concat(F.lit("diff_"), F.col(time)))
            .select(*units, label, *values))


def add_constant_baseline(df: DataFrame, units: Sequence[str], time: str, value: str, baseline: str,
                          constant: float = 0.0) -> DataFrame:
    """Add one baseline row with a constant value for every unit."""
    base = df.select(*units).distinct().withColumns({time: F.lit(baseline), value: F.lit(float(constant))})
    return df.select(*units, time, value).unionByName(base)


def log_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str], prefix: str = "ln") -> DataFrame:
    """Natural log per parameter, one column each; values <= 0 become NULL."""
    cells = df.groupBy(*ids).pivot(name, list(names)).agg(F.max(natural_log(value)))
    return cells.withColumnsRenamed({n: f"{prefix}{n}" for n in names})


def times_wide(df: DataFrame, units: Sequence[str], time: str, value: str, levels: Sequence[str], prefix: str = "T") -> DataFrame:
    """One row per unit with a column per time."""
    wide = df.groupBy(*units).pivot(time, list(levels)).agg(F.max(value))
    return wide.withColumnsRenamed({t: f"{prefix}{t}" for t in levels})


def recovery(df: DataFrame, units: Sequence[str], time: str, value: str, start: str, end: str, days: float) -> DataFrame:
    """Difference between two times of a unit, and the same per day."""
    wide = times_wide(df, units, time, value, [start, end])
    gain = F.col(f"T{end}") - F.col(f"T{start}")
    return wide.select(*units, gain.alias("recov"), (gain / F.lit(float(days))).alias("recovday"))


def utilisation(df: DataFrame, units: Sequence[str], by: Sequence[str], time: str, value: str, before: str, after: str) -> DataFrame:
    """Percent used between two times: mean and standard error over the units of a group."""
    wide = times_wide(df, units, time, value, [before, after])
    used = wide.withColumn("ut", ratio(F.col(f"T{after}") - F.col(f"T{before}"), f"T{before}") * 100)
    return used.groupBy(*by).agg(F.avg("ut").alias("avg"), se_of("ut", na_rm=True).alias("se"),
                                 F.count("ut").alias("n"))


def baseline_covariate(df: DataFrame, units: Sequence[str], time: str, value: str, baseline: str,
                       name: str = "T_PRE") -> DataFrame:
    """Later rows with the unit's baseline value in a column of its own."""
    base = F.avg(F.when(F.col(time) == baseline, F.col(value))).alias(name)
    return with_group_stats(df, units, [base]).filter(F.col(time) != baseline)


def composite_ratios(wide: DataFrame, carbon: Sequence[str], nitrogen: Sequence[str], phosphorus: str,
                     dissolved_c: str | None = None, dissolved_n: str | None = None) -> DataFrame:
    """Sums of the carbon and nitrogen columns and their stoichiometric ratios.

    ``CP`` and ``NP`` add 1 to both terms; a zero ``dissolved_n`` divides by 1 instead.
    """
    c = sum((F.col(x) for x in carbon[1:]), F.col(carbon[0]))
    n = sum((F.col(x) for x in nitrogen[1:]), F.col(nitrogen[0]))
    out = wide.withColumns({"Ccycl": c, "Ncycl": n}).withColumns({
        "CNrat": ratio("Ccycl", "Ncycl"),
        "CP": ratio(F.col("Ccycl") + 1, F.col(phosphorus) + 1),
        "NP": ratio(F.col("Ncycl") + 1, F.col(phosphorus) + 1)})
    if dissolved_c and dissolved_n:
        safe_n = F.when(F.col(dissolved_n) == 0, F.lit(1.0)).otherwise(F.col(dissolved_n))
        out = out.withColumns({"CDOC": ratio("Ccycl", dissolved_c), "NDON": ratio("Ncycl", safe_n)})
        out = out.withColumn("CdocNdon", ratio("CDOC", "NDON"))
    return out
