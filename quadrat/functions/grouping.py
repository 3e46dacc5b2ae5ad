"""Group statistics, ranks and numbering that hold when one group owns a large share of all rows.

* Statistics of a group are aggregated (map-side combined) and joined back, never computed in a window over its rows.
  The NULL-safe join puts a shuffle under both sides, so that adaptive execution can split a hot key's partition, or
  drop the shuffle of the rows when the statistics turn out small enough to broadcast.
* Ranks are taken over distinct values (ties collapse in the combine). A group with very many distinct values is cut
  into value ranges first, so that many tasks share its sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 500_000   # distinct values of one group that a single task sorts
MAX_HOT = 1024       # groups cut into ranges; any other group then has less than 1/1024 of all values
_SIDE = 32           # a hot group is cut into _SIDE * _SIDE value ranges


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", small: bool = False) -> DataFrame:
    """NULL-safe join on equally named keys, keeping the left copy of them."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(F.broadcast(right) if small else right, cond, how).drop(*[f"__{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one statistics row per key to the rows of ``df``; without keys the one row goes to all."""
    if keys:
        return keyed_join(df, stats, keys, how)
    one = stats.select(F.struct(*stats.columns).alias("_one")).agg(F.max("_one")).scalar()
    return df.withColumn("_one", one).select("*", "_one.*").drop("_one")


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Every row together with the aggregates of its group."""
    return attach(df, df.groupBy(*keys).agg(*aggs), keys)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` in ``parts`` partitions by its keys, so that tasks which combine or sort it stay as small however much there is; as it is if
    None. Spark's own number of partitions is fixed, and adaptive execution merges small ones up to the number of cores."""
    return df.repartition(parts, *keys) if parts else df


def _range_bounds(df: DataFrame, by: Sequence[str], value: str, hot_rows: int) -> DataFrame | None:
    """Value bounds of the groups too large for one sort, at most ``MAX_HOT`` rows; None if there are none.

    ``df`` has a row per distinct value, so a value that many rows share is one value to the quantile sketch too.
    """
    sizes = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("_d")).filter(F.col("_d") > hot_rows)
    hot = sizes.orderBy(F.desc("_d")).limit(MAX_HOT).collect()
    if not hot:
        return None
    rows = df
    if by:
        names = df.sparkSession.createDataFrame([r[: len(by)] for r in hot], df.select(*by).schema)
        rows = keyed_join(df, names, by, "inner", small=True)
    cuts = _SIDE * _SIDE
    quantiles = rows.groupBy(*by).agg(
        F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 20 * cuts).alias("_q"))
    return quantiles.select(
        *by, F.expr(f"transform(sequence(1, {_SIDE - 1}), i -> element_at(_q, i * {_SIDE}))").alias("_coarse"),
        F.expr(f"transform(sequence(0, {_SIDE - 1}), i -> slice(_q, i * {_SIDE} + 1, {_SIDE - 1}))").alias("_fine"))


def rank_cells(df: DataFrame, by: Sequence[str], value: str, carry: Sequence[Column] = (),
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct non-null value of each group, with its place in the order of the group.

    Columns: ``by``, ``value``, ``ties`` (rows with the value), ``before`` (rows of the group below it), ``size``
    (rows of the group), ``_range`` (value range, 0 unless the group is hot) and the ``carry`` aggregates.
    The average rank of the value is ``before + (ties + 1) / 2``.
    """
    present = df.filter(F.col(value).isNotNull())
    cells = present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"), *carry)
    bounds = _range_bounds(cells.select(*by, value), by, value, hot_rows)
    start = Window.unboundedPreceding
    if bounds is None:
        group = Window.partitionBy(*by)
        return cells.withColumns({
            "before": F.coalesce(F.sum("ties").over(group.orderBy(value).rowsBetween(start, -1)), F.lit(0)),
            "size": F.sum("ties").over(group), "_range": F.lit(0)})
    marked = keyed_join(cells, bounds, by, "left", small=True)
    marked = marked.withColumn("_c", F.size(F.filter("_coarse", lambda b: b < F.col(value))))
    inner = F.size(F.filter(F.element_at("_fine", F.col("_c") + 1), lambda b: b < F.col(value)))
    marked = marked.withColumn("_range", F.when(F.col("_coarse").isNull(), 0).otherwise(F.col("_c") * _SIDE + inner)).drop(
        "_coarse", "_fine", "_c")
    # At most _SIDE * _SIDE range totals per group meet in the small window.
    group = Window.partitionBy(*by)
    ranges = marked.groupBy(*by, "_range").agg(F.sum("ties").alias("_n")).withColumns({
        "_ahead": F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(start, -1)), F.lit(0)),
        "size": F.sum("_n").over(group)}).drop("_n")
    below = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(start, -1)
    placed = marked.withColumn("before", F.coalesce(F.sum("ties").over(below), F.lit(0)))
    return keyed_join(placed, ranges, [*by, "_range"], "inner").withColumn("before", F.col("before") + F.col("_ahead")).drop("_ahead")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics; no group is held in one task."""
    cells = rank_cells(df, by, value, hot_rows=hot_rows)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("ties")), F.col(value)))

    aggs, final = [], []
    for name, p in probs.items():
        h = (F.col("size") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"_w_{name}")]
        lo, hi, w = (F.col(f"_{part}_{name}") for part in ("lo", "hi", "w"))
        final.append((lo + w * (hi - lo)).alias(name))
    return cells.groupBy(*by).agg(F.max("size").alias("n"), *aggs).select(*by, "n", *final)


def number_keys(df: DataFrame, key: str, number: str, by: Sequence[str] = ()) -> DataFrame:
    """Number the distinct keys (of each group ``by``) 1..n in the order of (md5(key), key).

    The hash order splits the numbering evenly over 4096 prefixes whatever the keys look like; only the
    4096 prefix counts of a group meet in one task.
    """
    dim = (df.select(*by, key).distinct().withColumn("_h", F.md5(F.col(key).cast("string").cast("binary")))
           .withColumn("_p", F.substring("_h", 1, 3)))
    counts = dim.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    local = dim.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key)))
    placed = keyed_join(local, offsets, [*by, "_p"], "inner") if by else local.join(F.broadcast(offsets), "_p")  # 4096 rows
    return placed.select(*by, key, (F.col("_i") + F.col("_before")).alias(number))
