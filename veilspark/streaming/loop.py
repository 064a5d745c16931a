"""The scan loop: each micro-batch of frames goes through the gate, the detectors, and the choice of what to do."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import live, pipeline, stateful
from ..plans import scan
from .scans import gated

_LOG = "batch long, frames long, changed long, detections long, detectors_run long, failed string, seconds double"


class Loop:
    """Tables of a loop over frames (key, order, text) of several streams, below one folder.

    ``chosen`` are detectors of documents whose id is the column ``frame``, a
    name that the loop gives to each frame.

    ``states`` has a row for each frame: whether it changed, and for those that
    did the number of detections and what to show (alert, warn or clean; null
    for one that is as the frame before it, which is not scanned). ``found`` has
    the detections, ``log`` a line for each micro-batch. All are written under
    the batch's number and replaced when a batch is run again.
    """

    def __init__(self, path: str, chosen: dict[str, scan.Detector], key: str, order: str, text: str = "text", *, blur: float = pipeline.BLUR, warn: float = pipeline.WARN):
        self.path, self.chosen, self.key, self.order, self.text, self.blur, self.warn = path, chosen, key, order, text, blur, warn

    def _shapes(self, frames: DataFrame) -> tuple[T.StructType, T.StructType]:
        own = [*frames.select(self.key, self.order).schema.fields]
        states = T.StructType([*own, T.StructField("changed", T.BooleanType()), T.StructField("n_detections", T.LongType()), T.StructField("state", T.StringType())])
        none = pipeline.with_actions(scan.no_detections(frames.sparkSession, T.StringType(), "frame"))
        return states, T.StructType([*own, *[f for f in none.schema.fields if f.name not in ("frame", "det_ord")]])

    def step(self, batch: DataFrame, number: int) -> None:
        """One micro-batch."""
        began, key, order = time.time(), self.key, self.order
        states, shape = self._shapes(batch)
        session = batch.sparkSession
        frame = F.concat_ws("/", F.col(key).cast("string"), F.col(order).cast("string"))
        rows = gated(batch, number, key, order, self.text, f"{self.path}/last").withColumn("frame", frame).persist()
        try:
            raw, failed = scan.isolated(rows.where("changed"), self.chosen, f"{self.path}/raw/{number}", "frame")
            acted = pipeline.merge_overlaps(pipeline.with_actions(raw, self.blur, self.warn), "frame")
            found = rows.select(key, order, "frame").join(acted.drop("det_ord"), "frame")
            found.select(shape.names).write.mode("overwrite").parquet(f"{self.path}/found/batch={number}")
            told = session.read.schema(shape).parquet(f"{self.path}/found/batch={number}")
            per = told.groupBy(key, order).agg(F.count("*").alias("n"), F.max(F.col("action") == "blur").alias("blur"), F.max(F.col("action") == "warn").alias("warn"))
            both = rows.select(key, order, "changed").join(per.select(F.col(key).alias("__k"), F.col(order).alias("__o"), "n", "blur", "warn"), F.col(key).eqNullSafe(F.col("__k")) & F.col(order).eqNullSafe(F.col("__o")), "left")
            shown = stateful.ui_state(F.lit(True), F.coalesce("blur", F.lit(False)), F.coalesce("warn", F.lit(False)))
            out = both.select(key, order, "changed", F.when(F.col("changed"), F.coalesce("n", F.lit(0))).cast("long").alias("n_detections"), F.when(F.col("changed"), shown).alias("state"))
            out.write.mode("overwrite").parquet(f"{self.path}/states/batch={number}")
        finally:
            rows.unpersist()
        done = session.read.schema(states).parquet(f"{self.path}/states/batch={number}").agg(F.count("*"), F.count(F.when(F.col("changed"), 1)), F.sum("n_detections")).first()
        line = (number, done[0], done[1], done[2] or 0, len(self.chosen) - len(failed), ",".join(failed), time.time() - began)
        session.createDataFrame([line], _LOG).write.mode("overwrite").json(f"{self.path}/log/batch={number}")

    def run(self, frames: DataFrame, checkpoint: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Goes through what there is of a stream; returns (states, found, log)."""
        spark = frames.sparkSession
        states, shape = self._shapes(frames)
        for name, schema in (("states", states), ("found", shape)):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/batch=-1")
        spark.createDataFrame([], _LOG).write.mode("overwrite").json(f"{self.path}/log/batch=-1")
        frames.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*schema.names)
        return read("states", states), read("found", shape), spark.read.schema(_LOG).json(f"{self.path}/log").drop("batch")


def triggers(states: DataFrame, key: str, at: str) -> DataFrame:
    """Marks of live holds: a frame that shows something to cover is a trigger at its time."""
    return live.marks(states, key, at, F.col("state") == "alert", F.lit(False), F.lit(None).cast("string"))
