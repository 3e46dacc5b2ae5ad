"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3. A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled(rows: DataFrame, label: str) -> DataFrame:
    """The distinct rows (doc_id, label) that a model may learn from: neither held out nor NULL."""
    return rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", label).distinct()


def labelled_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (doc_id, label) for each label, those whose id hashes lowest; held-out and NULL rows never."""
    known = labelled(rows, label)
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return known.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_label).drop("_place")
