"""Detection logs as JSON lines, and tables of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "timestamp string, type string, confidence double, text string, bounding_box array<bigint>, action string"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a column of JSON lines; malformed lines are left out."""
    parsed = lines.select(F.from_json(column, SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images below ``path`` (origin, height, width, nChannels, mode, data)."""
    return spark.read.format("image").load(path).select("image.*")


def clear(spark: SparkSession, path: str) -> None:
    """Empties a log; one that does not exist stays so."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def cycled(frames: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows (tick, ...) that go through the frames again and again in order of ``order``, which is unique.

    Only the values of ``order`` are numbered, without the frames.
    """
    ranks = frames.select(order).distinct()
    count = ranks.count()
    if not count:
        raise ValueError("no frames to cycle through")
    numbered = ranks.withColumn("__k", F.row_number().over(Window.orderBy(order)) - 1)
    ticks = frames.sparkSession.range(n).select(F.col("id").alias("tick"), (F.col("id") % count).cast("int").alias("__k"))
    return ticks.join(numbered, "__k").join(frames, order).drop("__k")
