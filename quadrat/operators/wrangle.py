"""Relational shaping: rename, recode, reshape, look up, complete, select top taxa."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.grouping import keyed_join, number_keys
from quadrat.functions.semantics import level_ordinal


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def rename(df: DataFrame, **new_old: str) -> DataFrame:
    """``rename(df, new="old")``."""
    return df.withColumnsRenamed({old: new for new, old in new_old.items()})


def prefix_names(df: DataFrame, column: str, prefix: str, strip: str | None = None) -> DataFrame:
    """Put a prefix before the names in a column, after removing a pattern from them."""
    name = F.regexp_replace(column, strip, "") if strip else F.col(column)
    return df.withColumn(column, F.concat(F.lit(prefix), name))


def keep_values(df: DataFrame, column: str, values: Iterable, negate: bool = False) -> DataFrame:
    inside = F.col(column).isin(list(values))
    return df.filter(~inside if negate else inside)


def keep_found_in(df: DataFrame, column: str, constant: str) -> DataFrame:
    """Rows whose value occurs inside the constant text."""
    return df.filter(F.lit(constant).contains(F.col(column)))


def keep_complete(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns) or None)


def split_key(df: DataFrame, key: str, parts: dict[int, str], sep: str = "_") -> DataFrame:
    """Take 1-based pieces of a composite key into columns; a missing piece is NULL."""
    pieces = F.split(F.col(key), re.sub(r"([^\w\s])", r"\\\1", sep), -1)  # the separator as it is, no pattern
    return df.withColumns({name: F.get(pieces, i - 1) for i, name in parts.items()})


def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace the listed values and keep all others."""
    return df.replace(mapping, subset=[column])


def case_when(cases: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first true condition; NULL when none holds."""
    out = F.when(*cases[0])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def order_levels(df: DataFrame, column: str, levels: Sequence[str], name: str = "ord") -> DataFrame:
    return df.withColumn(name, level_ordinal(column, levels))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "param", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence[str], values: Sequence[str],
          prefix: str = "", combine: Callable[[str], Column] | None = None) -> DataFrame:
    """One column per name (and per value column, as ``<value>_<name>``) from an explicit name list.

    Several values for one cell are an error, unless ``combine`` (such as ``F.avg``) says what becomes of them.
    """
    if combine is None:
        several = F.raise_error(F.lit("pivot: several values for one cell; give combine"))
        df = df.groupBy(*ids, names_from).agg(*[F.when(F.count(v) > 1, several).otherwise(F.max(v)).alias(v) for v in values])
        combine = F.max
    wide = df.groupBy(*ids).pivot(names_from, list(names))
    if len(values) == 1:
        return wide.agg(combine(values[0])).withColumnsRenamed({n: f"{prefix}{n}" for n in names})
    out = wide.agg(*[combine(v).alias(v) for v in values])
    return out.withColumnsRenamed({f"{n}_{v}": f"{prefix}{v}_{n}" for n in names for v in values})


def complete_samples(df: DataFrame, samples: DataFrame, key: str, values: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Add the samples that are missing from ``df`` with the fill value in every value column."""
    absent = keep_unmatched(samples.select(key).distinct(), df, [key])
    filled = absent.withColumns({v: F.lit(fill).cast(df.schema[v].dataType) for v in values})
    return df.unionByName(filled, allowMissingColumns=True)


def lookup(df: DataFrame, dim: DataFrame, keys: dict[str, str] | Sequence[str], how: str = "left") -> DataFrame:
    """Left equi-join with a lookup table; ``keys`` maps a column of ``df`` to its name in the lookup.

    A missing key matches a missing key. No hint is given: Spark broadcasts a lookup whose size, from file statistics
    or measured at run time, is below ``spark.sql.autoBroadcastJoinThreshold``, and shuffles (splitting skewed
    partitions) above it.
    """
    pairs = keys if isinstance(keys, dict) else {k: k for k in keys}
    cond = F.lit(True)
    right = dim.withColumnsRenamed({r: f"__{r}" for r in pairs.values()})
    for left_key, right_key in pairs.items():
        cond = cond & F.col(left_key).eqNullSafe(F.col(f"__{right_key}"))
    return df.join(right, cond, how).drop(*[f"__{r}" for r in pairs.values()])


def keep_matching(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table; a missing key matches a missing key."""
    return keyed_join(df, other.select(*keys).distinct(), keys, "left_semi")


def keep_unmatched(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in the other table."""
    return keyed_join(df, other.select(*keys).distinct(), keys, "left_anti")


def bind_columns(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put the columns of two tables side by side by key (never by row order)."""
    return left.join(right, [key] if isinstance(key, str) else list(key), "inner")


def stack_rows(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Rows of several tables below each other, each tagged with its name."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def surrogate_ids(df: DataFrame, key: str, name: str, prefix: str = "ASV") -> DataFrame:
    """Short ids ``<prefix>1..n`` for the distinct keys, in hash order."""
    numbers = number_keys(df, key, "_n")
    return numbers.select(key, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias(name))


def top_k(df: DataFrame, by: str, value: str, k: int, name: str = "total") -> DataFrame:
    """The k groups with the largest sum of a value; equal sums are ordered by name."""
    return df.groupBy(by).agg(F.sum(value).alias(name)).orderBy(F.desc(name), by).limit(k)
