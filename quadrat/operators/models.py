"""Linear models of designed experiments, fitted for all parameters in one grouped query.

The rows of a model are reduced by a partial + final aggregate to one row per design cell: count, mean and inner sum of
squares. These are sufficient for every fit, F test and contrast here, so Python sees only design cells: at most the
product of the factor levels per parameter, however many rows there were.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.grouping import attach
from quadrat.functions.semantics import level_ordinal, ratio
from quadrat.functions.tails import p_f, p_studentised_range, p_two_sided_t, q_studentised_range


def design_cells(df: DataFrame, by: Sequence[str], factors: Sequence[str], y: str) -> DataFrame:
    """Count, mean and inner sum of squares per design cell; missing values are left out."""
    return df.filter(F.col(y).isNotNull()).groupBy(*by, *factors).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_mean"), F.var_pop(y).alias("_v")).select(
        *by, *factors, "_n", "_mean", (F.col("_v") * F.col("_n")).alias("_ss"))


def full_factorial(factors: Sequence[str]) -> list[tuple[str, ...]]:
    """All main effects, then all interactions by order."""
    return [c for size in range(1, len(factors) + 1) for c in combinations(factors, size)]


def _term_columns(cells: pd.DataFrame, term: Sequence[str]) -> np.ndarray:
    codes = cells[list(term)].astype(str).agg("\x1f".join, axis=1)
    return (codes.to_numpy()[:, None] == np.unique(codes)[None, :]).astype(float)


def _sequential_fit(cells: pd.DataFrame, terms: Sequence[Sequence[str]]):
    """Weighted least squares on the cell means, one term after the other.

    Returns (df, ss) per term, residual df and ss, null ss, and the fitted cell means.
    """
    n = cells["_n"].to_numpy(float)
    root = np.sqrt(n)
    grand = np.average(cells["_mean"], weights=n)
    target = root * (cells["_mean"].to_numpy(float) - grand)
    basis = [root / np.linalg.norm(root)]
    fitted = np.zeros(len(cells))
    found = []
    for term in terms:
        df, ss = 0, 0.0
        for column in _term_columns(cells, term).T:
            v = column * root
            length = np.linalg.norm(v)
            for _ in range(2):
                for b in basis:
                    v = v - b * (b @ v)
            if np.linalg.norm(v) > 1e-9 * length:
                v = v / np.linalg.norm(v)
                basis.append(v)
                along = v @ target
                fitted += along * v
                df, ss = df + 1, ss + along * along
        found.append((df, ss))
    within = float(cells["_ss"].sum())
    residual = target - fitted
    rss = within + float(residual @ residual)
    null = within + float(target @ target)
    return found, int(n.sum()) - len(basis), rss, null, grand + fitted / root


def _key_fields(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in by]


def _per_model(cells: DataFrame, by: Sequence[str], fields: str, rows_of) -> DataFrame:
    """Run ``rows_of(cells of one model) -> list of tuples`` for every model."""
    schema = T.StructType([*_key_fields(cells, by), *T.StructType.fromDDL(fields).fields])
    names = [f.name for f in schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(pdf[k].iloc[0] for k in by)
        return pd.DataFrame([(*key, *row) for row in rows_of(pdf)], columns=names)

    return cells.groupBy(*by).applyInPandas(run, schema)


def linear_model(df: DataFrame, by: Sequence[str], factors: Sequence[str], y: str,
                 terms: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Gaussian fit per model: residual and null deviance, their difference, degrees of freedom, residual variance."""
    terms = terms or full_factorial(factors)

    def rows(pdf):
        found, df_res, rss, null, _ = _sequential_fit(pdf, terms)
        yield (rss, null, null - rss, int(pdf["_n"].sum()) - 1, df_res, rss / df_res if df_res > 0 else None)

    return _per_model(design_cells(df, by, factors, y), by,
                      "deviance double, null_deviance double, diff double, df_null long, df_residual long, sigma2 double", rows)


def anova(df: DataFrame, by: Sequence[str], factors: Sequence[str], y: str,
          terms: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Sequential (type I) F test of every term, in the order given."""
    terms = terms or full_factorial(factors)

    def rows(pdf):
        found, df_res, rss, _, _ = _sequential_fit(pdf, terms)
        for term, (df_term, ss) in zip(terms, found):
            usable = df_term > 0 and df_res > 0 and rss > 0
            f = ss / df_term / (rss / df_res) if usable else None
            yield (":".join(term), df_term, ss, f, df_res)

    found = _per_model(design_cells(df, by, factors, y), by, "term string, df long, ss double, fstat double, _res long", rows)
    return found.withColumn("pval", p_f("fstat", F.col("df").cast("double"), F.col("_res").cast("double"))).drop("_res")


def coefficients(df: DataFrame, by: Sequence[str], factors: Sequence[str], y: str, levels: dict[str, Sequence[str]],
                 terms: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Coefficient table of a linear model in treatment contrasts: term, estimate, se, t, p.

    The first of a factor's ``levels`` is its reference; rows of other levels are left out. Normal equations are built from the design
    cells, whatever the number of rows. A coefficient that the coefficients before it already explain has NULL values, as have
    se, t and p without residual degrees of freedom.
    """
    terms = terms or full_factorial(factors)
    named = [("(Intercept)", {})]
    for term in terms:
        for chosen in product(*[levels[f][1:] for f in term]):
            named.append((":".join(f"{f}[{v}]" for f, v in zip(term, chosen)), dict(zip(term, chosen))))

    def rows(pdf):
        n, mean = pdf["_n"].to_numpy(float), pdf["_mean"].to_numpy(float)
        root = np.sqrt(n)
        columns = [root * np.prod([np.ones(len(pdf)), *((pdf[f] == v).to_numpy(float) for f, v in want.items())], axis=0) for _, want in named]
        kept, basis = [], []
        for k, column in enumerate(columns):
            v = column.copy()
            for _ in range(2):
                for b in basis:
                    v = v - b * (b @ v)
            if np.linalg.norm(v) > 1e-9 * max(np.linalg.norm(column), 1e-300):
                kept.append(k)
                basis.append(v / np.linalg.norm(v))
        upper = np.array(basis) @ np.array([columns[k] for k in kept]).T  # triangular: kept columns in terms of the basis
        inverse = np.linalg.inv(upper)
        target = root * mean
        estimates = inverse @ (np.array(basis) @ target)
        off = target - np.array(basis).T @ (np.array(basis) @ target)
        df_res = int(n.sum()) - len(kept)
        sigma2 = (float(pdf["_ss"].sum()) + float(off @ off)) / df_res if df_res > 0 else None
        spread = (inverse ** 2).sum(1)
        known = {k: (float(e), math.sqrt(sigma2 * v) if sigma2 is not None else None) for k, e, v in zip(kept, estimates, spread)}
        for k, (name, _) in enumerate(named):
            estimate, se = known.get(k, (None, None))
            yield (k, name, estimate, se, estimate / se if se else None, df_res)

    listed = df
    for f in factors:
        listed = listed.where(F.col(f).isin(list(levels[f])))
    found = _per_model(design_cells(listed, by, factors, y), by, "place int, term string, estimate double, se double, t double, _res long", rows)
    return found.withColumn("p", p_two_sided_t("t", F.col("_res").cast("double"))).drop("_res")


def residuals(df: DataFrame, by: Sequence[str], factors: Sequence[str], y: str,
              terms: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """The rows with their fitted value and residual."""
    cells = design_cells(df, by, factors, y)
    if terms is None:  # every cell has its own mean
        fits = cells.select(*by, *factors, F.col("_mean").alias("fitted"))
    else:
        schema = T.StructType([*_key_fields(cells, [*by, *factors]), *T.StructType.fromDDL("fitted double").fields])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.assign(fitted=_sequential_fit(pdf, terms)[4])[[f.name for f in schema.fields]]

        fits = cells.groupBy(*by).applyInPandas(run, schema)
    rows = attach(df, fits, [*by, *factors])
    return rows.withColumn("residual", F.col(y) - F.col("fitted"))


def _pooled(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Residual variance of the model with one mean per cell."""
    s = cells.groupBy(*by).agg(F.sum("_ss").alias("_rss"), (F.sum("_n") - F.count(F.lit(1))).alias("_dfr"))
    return s.select(*by, "_dfr", F.try_divide("_rss", "_dfr").alias("_s2"))


def _level_pairs(cells: DataFrame, by: Sequence[str], factor: str, levels: Sequence[str]) -> DataFrame:
    """All pairs of levels inside each group, first level of the given order first (levels are few and listed)."""
    ranked = cells.withColumn("_o", level_ordinal(factor, levels)).filter(F.col("_o").isNotNull())
    held = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("_o", F.col(factor).alias("level"), "_n", "_mean"))).alias("_cells"))
    first = held.select(*by, "_cells", F.explode("_cells").alias("_first"))
    return first.select(*by, "_first", F.explode(F.filter("_cells", lambda c: c["_o"] > F.col("_first._o"))).alias("_second"))


def emmeans_pairwise(df: DataFrame, by: Sequence[str], factor: str, within: str, levels: Sequence[str], y: str,
                     df_mode: str = "inf", p_value: bool = True) -> DataFrame:
    """Pairwise contrasts of cell means of ``factor`` inside each level of ``within``.

    The standard error comes from the residual variance pooled over all cells of the model. ``df_mode='inf'`` refers the
    ratio to the normal distribution, ``'residual'`` to t; p values are adjusted by the studentised range.
    """
    if df_mode not in ("inf", "residual"):
        raise ValueError(df_mode)
    cells = design_cells(df, by, [factor, within], y)
    pooled = _pooled(cells, by)
    pairs = _level_pairs(cells, [*by, within], factor, levels)
    out = attach(pairs, pooled, by)
    se = F.sqrt(F.col("_s2") * (1 / F.col("_first._n") + 1 / F.col("_second._n")))
    out = out.select(*by, within, F.concat_ws(" - ", "_first.level", "_second.level").alias("contrast"),
                     (F.col("_first._mean") - F.col("_second._mean")).alias("estimate"), se.alias("se"),
                     F.col("_dfr").cast("double").alias("df"))
    out = out.withColumn("ratio", ratio("estimate", "se"))
    if df_mode == "inf":
        out = out.withColumn("df", F.lit(float("inf")))
    if not p_value:
        return out
    nodes = F.when(F.col("df") < F.lit(float("inf")), F.col("df"))
    return out.withColumn("p", p_studentised_range(F.abs("ratio") * F.sqrt(F.lit(2.0)), F.lit(len(levels)), nodes))


def tukey_hsd(df: DataFrame, by: Sequence[str], factors: Sequence[str], y: str, which: str, levels: Sequence[str],
              confidence: float = 0.95, p_value: bool = True) -> DataFrame:
    """All pairs of one factor's observed means: difference (later minus earlier), interval, adjusted p.

    The error variance is that of the full factorial model; unequal counts enter as in the Tukey-Kramer method.
    """
    cells = design_cells(df, by, factors, y)
    means = cells.groupBy(*by, which).agg(F.sum("_n").alias("_n"), (F.sum(F.col("_mean") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    pairs = _level_pairs(means, by, which, levels)
    pooled = _pooled(cells, by)
    out = attach(pairs, pooled, by)
    se = F.sqrt(F.col("_s2") / 2 * (1 / F.col("_first._n") + 1 / F.col("_second._n")))
    out = out.select(*by, F.concat_ws("-", "_second.level", "_first.level").alias("contrast"),
                     (F.col("_second._mean") - F.col("_first._mean")).alias("diff"), se.alias("se"), F.col("_dfr").alias("df"))
    if not p_value:
        return out
    k, dfr = F.lit(len(levels)), F.col("df").cast("double")
    out = out.withColumn("_q", q_studentised_range(F.lit(1 - confidence), k, dfr))
    return out.select(*by, "contrast", "diff", "se", "df", (F.col("diff") - F.col("_q") * F.col("se")).alias("lower"),
                      (F.col("diff") + F.col("_q") * F.col("se")).alias("upper"),
                      p_studentised_range(ratio(F.abs("diff"), "se"), k, dfr).alias("p"))
