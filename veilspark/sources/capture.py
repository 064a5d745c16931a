"""Frames by the kind of their source: image files, once or as a stream that goes through them again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs

KINDS = ("files", "screen")


def _images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images that could be read; there has to be one."""
    found = logs.images(spark, path).where("height > 0 AND width > 0").select("origin", "height", "width", "nChannels", "data")
    if found.isEmpty():
        raise FileNotFoundError(f"no image below {path}")
    return found


def frames(spark: SparkSession, kind: str, path: str | None = None, n: int | None = None) -> DataFrame:
    """(tick, origin, height, width, nChannels, data): ``n`` frames, or each image once; images come in the order of their paths."""
    if kind not in KINDS:
        raise ValueError(f"a source is one of {', '.join(KINDS)}, not {kind}")
    if kind == "screen" or path is None:
        raise ValueError("a cluster has no screen: name a path with images")
    images = _images(spark, path)
    return logs.cycled(images, n if n is not None else images.count(), "origin")


def stream(spark: SparkSession, kind: str, path: str | None = None, per_batch: int = 1, start_ms: int = 0, step_ms: int = 1000) -> DataFrame:
    """As ``frames`` without an end, ``per_batch`` of them in a micro-batch, with the time ``ts`` of each batch, ``step_ms`` apart.

    Ticks are Spark's, and meet the images in a join: a frame is read where it
    is needed, and a batch that is run again has the frames that it had.
    """
    images = frames(spark, kind, path)
    count = images.count()
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).option("startTimestamp", start_ms).option("advanceMillisPerBatch", step_ms).load()
    numbered = images.withColumnRenamed("tick", "__k")
    cut = ticks.select(F.col("value").alias("tick"), F.col("timestamp").alias("ts"), (F.col("value") % count).alias("__k"))
    return cut.join(numbered, "__k").select("tick", "ts", "origin", "height", "width", "nChannels", "data")
