"""Session settings for scripts and tests; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "quadrat") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUADRAT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one below the warehouse, which a cluster must share too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if not spark.sparkContext.master.startswith("local") and re.match(r"file:|/", base):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return base


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the session names, so that a lost executor costs no replay."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder for files that driver and executors share."""
    return f"{checkpoint_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spent(table: DataFrame) -> None:
    """Remove the folder of a table that ``stored`` gave, once everything that reads it has been written."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
