"""Streaming forms: holds by session windows, change gate with stored last values, scan per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cards


def holds(triggers: DataFrame, key: str, ts: str, hold: str, late: str = "10 seconds") -> DataFrame:
    """As the batch form, in append mode: a hold is put out when the watermark has passed its end."""
    s = triggers.withWatermark(ts, late).groupBy(key, F.session_window(ts, hold).alias("s")).agg(F.count("*").alias("n_triggers"))
    return s.select(key, F.col("s.start").alias("hold_start"), F.col("s.end").alias("hold_end"), "n_triggers")


def gated(batch: DataFrame, number: int, key: str, order: str, value: str, path: str) -> DataFrame:
    """The rows of a micro-batch (key, order, value, changed), compared in order with those before them.

    A window does it, which spills and does not see how a batch is cut for
    Python. The last value of each key is a table that each micro-batch reads
    and writes anew under its own number, so that one that is run again gives
    the same rows.
    """
    w = Window.partitionBy(key).orderBy("__new", order)
    place = F.struct("__new", order)
    rows = batch.select(key, order, value, F.lit(1).alias("__new"))
    if number:
        last = batch.sparkSession.read.schema(batch.select(key, order, value).schema).parquet(f"{path}/{number - 1}")
        rows = rows.unionByName(last.withColumn("__new", F.lit(0)))
    last = rows.groupBy(key).agg(F.max(place).alias("__at"), F.max_by(value, place).alias(value))
    last.select(key, F.col(f"__at.{order}").alias(order), value).write.mode("overwrite").parquet(f"{path}/{number}")
    changed = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("changed", changed).where("__new = 1").drop("__new")


def change_gate_table(frames: DataFrame, key: str, order: str, value: str, path: str, checkpoint: str) -> DataFrame:
    """(key, order, changed) of a stream over what there is, written to Parquet and read."""
    spark = frames.sparkSession
    schema = frames.select(key, order).schema.add("changed", "boolean")

    def gate(batch: DataFrame, number: int) -> None:
        rows = gated(batch, number, key, order, value, f"{path}-last")
        rows.select(key, order, "changed").write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    frames.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path).select(key, order, "changed")


def card_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Card candidates need no state and no shuffle, so the batch operator is the streaming one."""
    return cards.candidates(docs, id_col, text_col)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into Parquet, and reads it."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def switching_scenes(current: Column, in_hold: Column, privacy: str) -> Column:
    """The scene to show: the privacy scene during a hold, else the current one."""
    return F.when(in_hold, privacy).otherwise(current)
