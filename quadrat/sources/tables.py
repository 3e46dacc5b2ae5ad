"""Readers and writers: delimited text as laboratories deliver it, and Parquet for everything large."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The mark of a missing value in text files, unless another is given.
MISSING = "NULL"


def scan_tsv(spark: SparkSession, path: str, schema: str | T.StructType, missing: str = MISSING, mode: str = "FAILFAST") -> DataFrame:
    """Tab-separated text with a header; handles byte-order mark, CRLF, padded cells and marks of missing values.

    The header must name the columns of ``schema`` in its order, and a cell that is no value of its type is an error, unless
    ``mode`` is PERMISSIVE (such cells become NULL) or DROPMALFORMED.
    """
    return (
        spark.read.schema(schema)
        .option("sep", "\t").option("header", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", missing).option("enforceSchema", False).option("mode", mode)
        .csv(path))


def scan_parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", missing: str = MISSING) -> None:
    """A folder of tab-separated parts with headers, which ``scan_tsv`` reads back; parallel, nothing is gathered."""
    df.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", missing).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def clean_keys(df: DataFrame, key: str, to: str = "int") -> DataFrame:
    """Cast a lookup key and drop the rows in which it is not a value of that type."""
    return df.withColumn(key, F.col(key).try_cast(to)).filter(F.col(key).isNotNull())
