"""Whole analyses put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.change import add_constant_baseline, percent_change
from quadrat.operators.summary import mean_se
from quadrat.operators.wrangle import lookup

TIMES = ("PRE", "24H", "1WK", "4WK")


def conform(measures: DataFrame, lookups: Sequence[tuple[DataFrame, dict[str, str] | Sequence[str]]], drop: Sequence[str]) -> DataFrame:
    """Raw measures with the columns of several lookup tables, joined in the given order, in place of their keys."""
    for table, keys in lookups:
        measures = lookup(measures, table, keys)
    return measures.drop(*drop)


def change_summary(long: DataFrame, units: Sequence[str], by: Sequence[str], time: str = "time", value: str = "value",
                   times: Sequence[str] = TIMES, na_rm: bool = True) -> DataFrame:
    """Mean and standard error of the percent change from baseline, per group and later time."""
    change = percent_change(long, units, time, times, times[0], [value])
    if na_rm:
        change = change.filter(F.col(value).isNotNull())
    return mean_se(change, [*by, "diffTimeSeries"], {value: ""})


def change_with_baseline(long: DataFrame, units: Sequence[str], time: str = "time", value: str = "value",
                         times: Sequence[str] = TIMES) -> DataFrame:
    """Percent changes of complete units with the baseline itself added as 0: the input of the models."""
    change = percent_change(long, units, time, times, times[0], [value], label="Time").filter(F.col(value).isNotNull())
    return add_constant_baseline(change, units, "Time", value, times[0])
