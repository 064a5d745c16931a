"""What several modules of queries need: settings, tables, streams of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ScanConfig

STRINGS = ("Apache License", "Version 2.0", "pathetic")
CONFIG = ScanConfig(strings=STRINGS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def spread(docs: DataFrame) -> DataFrame:
    """Documents of a table with fewer pieces than there are cores (a small file of one row group), dealt to all of them.

    Detectors work inside the row, so that the scan's pieces are their tasks. A
    table of a corpus has more pieces than cores and stays as it is.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def customer_text() -> Column:
    """Four kinds of personal strings, by the customer's key."""
    key = F.col("c_custkey").cast("string")
    return (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("c"), key, F.lit("@mail.example")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("+1 555 "), F.lpad(key, 7, "0")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(key, F.lit(" Main Rd")))
        .otherwise(F.col("c_name"))
    )


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    # as a pattern, the path can be a file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
