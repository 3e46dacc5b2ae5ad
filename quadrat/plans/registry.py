"""Registered queries: a name, the Spark query, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.grouping import dealt
from quadrat.sources.tables import scan_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TASK_ROWS = 500_000  # line items that one task combines, about


class Tables:
    """The given tables of one folder, and the study roles built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, table: str) -> DataFrame:
        return scan_parquet(self.spark, self.folder, table)

    @cached_property
    def parts(self) -> int | None:
        """Partitions of line items, or of what is made of each of them, with ``TASK_ROWS`` rows; None where the cores' tasks hold no more."""
        rows = self.lineitem.count()
        return -(-rows // TASK_ROWS) if rows > TASK_ROWS * self.spark.sparkContext.defaultParallelism else None

    def measures(self, units: int | None = None) -> DataFrame:
        """Long measurements: unit, param, treatment, time, value. ``units`` pools the users into that many units."""
        unit = F.col("user_id") if units is None else F.col("user_id") % units
        day = F.dayofmonth("ts")
        time = F.when(day <= 7, "PRE").when(day <= 14, "24H").when(day <= 21, "1WK").otherwise("4WK")
        kind = F.floor(unit / 4) % 3
        treatment = F.when(kind == 0, "HI").when(kind == 1, "LO").otherwise("NO")
        return self.events.groupBy(unit.alias("unit"), F.col("event_type").alias("param"), treatment.alias("treatment"),
                                   time.alias("time")).agg(F.avg("value").alias("value"))

    def counts(self) -> DataFrame:
        """Counts of taxa (brand and type of a part) in samples (suppliers)."""
        taxa = self.part.select("p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("taxon_id"))
        lines = self.lineitem.select(F.col("l_suppkey").alias("sample_id"), "l_partkey", "l_quantity")
        known = dealt(lines, self.parts, "l_partkey").join(taxa, F.col("l_partkey") == F.col("p_partkey")).select("sample_id", "taxon_id", "l_quantity")
        return dealt(known, self.parts, "sample_id", "taxon_id").groupBy("sample_id", "taxon_id").agg(F.sum("l_quantity").cast("long").alias("count"))

    def part_counts(self) -> DataFrame:
        """The same at part level: a sparse matrix."""
        return dealt(self.lineitem, self.parts, "l_suppkey", "l_partkey").groupBy(
            F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("taxon_id")).agg(F.sum("l_quantity").cast("long").alias("count"))

    def taxonomy(self) -> DataFrame:
        return self.part.select(F.concat_ws("_", "p_brand", "p_type").alias("taxon_id"), F.lit("goods").alias("kingdom"),
                                F.col("p_type").alias("phylum"), F.col("p_brand").alias("genus")).distinct()

    def samples(self) -> DataFrame:
        nation = self.nation
        return self.supplier.join(nation, F.col("s_nationkey") == nation.n_nationkey).select(
            F.col("s_suppkey").alias("sample_id"), F.col("n_regionkey").cast("string").alias("region"),
            F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("half"), "s_acctbal")

    def site_variables(self) -> DataFrame:
        """Wide variables of every sample."""
        return self.lineitem.groupBy(F.col("l_suppkey").alias("sample_id")).agg(
            F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"),
            F.avg("l_extendedprice").alias("price"))


def _measures_sql(unit: str) -> str:
    return f"""
SELECT {unit} AS unit, event_type AS param,
       CASE ({unit} // 4) % 3 WHEN 0 THEN 'HI' WHEN 1 THEN 'LO' ELSE 'NO' END AS treatment,
       CASE WHEN day(ts) <= 7 THEN 'PRE' WHEN day(ts) <= 14 THEN '24H' WHEN day(ts) <= 21 THEN '1WK' ELSE '4WK' END AS time,
       avg(value) AS value
FROM events GROUP BY ALL"""


CTE = {
    "measures": _measures_sql("user_id"),
    "pooled": _measures_sql("(user_id % 36)"),
    "rounded_measures": "SELECT unit, param, treatment, time, round(value, 9) AS value FROM measures",
    "change": """
SELECT m.unit, m.param, m.treatment, 'diff_' || m.time AS "diffTimeSeries",
       (m.value - (b.value + 1e-6)) / (b.value + 1e-6) * 100 AS value
FROM measures m JOIN measures b ON b.unit = m.unit AND b.param = m.param AND b.time = 'PRE' WHERE m.time <> 'PRE'""",
    "pooled_change": """
SELECT m.unit, m.param, m.treatment, 'diff_' || m.time AS "Time",
       (m.value - (b.value + 1e-6)) / (b.value + 1e-6) * 100 AS value
FROM pooled m JOIN pooled b ON b.unit = m.unit AND b.param = m.param AND b.time = 'PRE' WHERE m.time <> 'PRE'
UNION ALL SELECT DISTINCT unit, param, treatment, 'PRE', 0.0 FROM pooled WHERE time = 'PRE'""",
    "counts": """
SELECT l_suppkey AS sample_id, p_brand || '_' || p_type AS taxon_id, CAST(sum(l_quantity) AS BIGINT) AS count
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "part_counts": """
SELECT l_suppkey AS sample_id, l_partkey AS taxon_id, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY ALL""",
    "samples": """
SELECT s_suppkey AS sample_id, CAST(n_regionkey AS VARCHAR) AS region,
       CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half, s_acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "site_variables": """
SELECT l_suppkey AS sample_id, avg(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax,
       avg(l_extendedprice) AS price FROM lineitem GROUP BY ALL""",
}
_NEEDS = {"rounded_measures": ["measures"], "change": ["measures"], "pooled_change": ["pooled"]}


def with_ctes(names: str, body: str) -> str:
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    return ("WITH RECURSIVE " if "UNION ALL SELECT * EXCLUDE" in body else "WITH ") + ", ".join(f"{n} AS ({CTE[n]})" for n in wanted) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().lstrip("+")


def query(sql: str | None = None, ctes: str = ""):
    """Register the decorated ``f(tables) -> DataFrame`` under its own name."""
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[f.__name__] = with_ctes(ctes, sql) if ctes else sql.lstrip()
        return f
    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round results so that both engines' orders of summation give the same number; -0.0 becomes 0.0.

    Spark rounds the decimal that a number prints as. Away from the middle between two neighbours, and below 2^36 of the last digit's
    units, the nearest whole number of such units gives the same, at a small part of the cost.
    """
    def near(c: str):
        units = F.col(c) * F.lit(float(10 ** digits))
        whole = F.rint(units)
        plain = (F.abs(units - whole) < F.lit(0.499)) & (F.abs(units) < F.lit(float(1 << 36)))
        return F.when(plain, whole / F.lit(float(10 ** digits)) + F.lit(0.0)).otherwise(F.round(F.col(c), digits) + F.lit(0.0))

    return df.withColumns({c: near(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.round(F.col(c), digits) + F.lit(0.0) for c in columns})
