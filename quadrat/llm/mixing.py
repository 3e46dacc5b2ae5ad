"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random key from a hash of its id. Documents are ordered by key inside their source and dealt to key
ranges; the words of whole ranges are summed first and prefix sums run over these sums, so that no task sees more than one
range, however large a source is. A source is cut where its budget of words ends, after as many whole epochs as fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Weights by place of the source in code-point order, and the most epochs that a source is repeated.
WEIGHTS, EPOCHS = (5, 2, 1), 3

#: Rows that one key range should hold.
RANGE_ROWS = 20_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))


def source_targets(sums: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Budget of each source from rows of (source, source_size): one row per source, with ``target``.

    All sizes are shared by weight; a target stops at ``epochs`` times its source's size and the excess goes to the others
    by weight. Sources run out in the order of that limit per weight, so one pass in this order finds all of them.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    by_limit = Window.orderBy("limit", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = sums.withColumn("weight", weight).withColumn("most", (epochs * F.col("source_size")).cast("double"))
    rows = rows.withColumn("limit", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_limit), F.lit(0.0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0))
    rows = rows.withColumn("level", left / shares)
    rows = rows.withColumn("full", F.col("limit") < F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def shares(sized: DataFrame, seed: int = 17, weights=WEIGHTS, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``sized`` (doc_id, source, size, any others) with source_size, target, whole_epochs, part and taken.

    ``part`` is the number of words of the document in the last, partial epoch. A NULL source is a source; equal keys are
    ordered by doc_id and size.
    """
    rows = sized.withColumn("_key", random_key("doc_id", seed))
    width = max(1, math.ceil(math.log(max(1, sized.count() / range_rows), 16)))
    rows = rows.withColumns({"_range": F.substring("_key", 1, width), "_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    ranges = rows.groupBy("_none", "_source", "_range").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_none", "_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    sums = ranges.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sums.withColumn("source", F.when(~F.col("_none"), F.col("_source"))), weights, epochs)
    targets = targets.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    plan = ranges.drop("_words").join(targets, ["_none", "_source"])
    inside = Window.partitionBy("_none", "_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(plan, ["_none", "_source", "_range"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"whole_epochs": whole, "_before": F.col("_base") + F.sum("size").over(inside) - F.col("size")})
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("whole_epochs") * F.col("source_size") - F.col("_before")))
    rows = rows.withColumn("part", part.cast("long")).withColumn("taken", (F.col("whole_epochs") * F.col("size") + F.col("part")).cast("long"))
    return rows.drop("_key", "_range", "_none", "_source", "_base", "_before")


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document once per epoch that takes it.

    The one document of a source that the budget cuts keeps its first words in its last copy, with their white space.
    Documents without words carry no budget and are left out; so are NULL texts. ``n_chars`` follows the text.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), "doc_id", "source", n_words("text").alias("size"))
    rows = shares(rows, seed, weights, epochs).where("taken > 0")
    copies = F.col("whole_epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("_copy") > F.col("whole_epochs")) & (F.col("part") < F.col("size"))
    runs = F.expr(r"regexp_extract_all(_row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)")
    text = F.when(cut, F.array_join(F.slice(runs, 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), "")).otherwise(F.col("_row.text"))
    new = {"text": text, "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in columns else None}
    return rows.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"_row.`{c}`").alias(c) for c in columns))
