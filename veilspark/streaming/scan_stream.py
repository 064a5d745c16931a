"""The whole scan on a stream of documents: all detectors on each micro-batch, and counts by type and time."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import api_keys, cards, personal, pipeline
from ..plans import scan
from ..plans.catalog_base import spread

_LOG = "batch long, rows long, detections long, detectors_run long, failed string, seconds double"


def detections(docs: DataFrame, chosen: dict[str, scan.Detector], path: str, checkpoint: str, id_col: str = "doc_id", *, blur: float = pipeline.BLUR, warn: float = pipeline.WARN) -> tuple[DataFrame, DataFrame]:
    """Scans a stream over what there is; returns the detections as ``plans.scan.detections`` has them, and the log.

    A document is scanned in the micro-batch that brings it. Every detector's
    rows are saved on their own, so that one that fails on some row leaves the
    others theirs. The log has one line for each micro-batch: its rows and
    detections, the detectors that finished, the names of those that failed, and
    the seconds it took. Everything is written under the batch's number and
    replaced when a batch is run again.
    """
    spark = docs.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        began, kept = time.time(), spread(batch).persist()
        try:
            raw, failed = scan.isolated(kept, chosen, f"{path}/raw/{number}", id_col)
            acted = pipeline.with_actions(raw, blur, warn)
            out = pipeline.ranked(pipeline.merge_overlaps(acted, id_col), id_col)
            out.write.mode("overwrite").parquet(f"{path}/detections/batch={number}")
            rows = kept.count()
        finally:
            kept.unpersist()
        session = batch.sparkSession
        found = session.read.schema(out.schema).parquet(f"{path}/detections/batch={number}").count()
        line = (number, rows, found, len(chosen) - len(failed), ",".join(failed), time.time() - began)
        session.createDataFrame([line], _LOG).write.mode("overwrite").json(f"{path}/log/batch={number}")

    empty = scan.no_detections(spark, docs.schema[id_col].dataType, id_col)
    shape = pipeline.ranked(pipeline.merge_overlaps(pipeline.with_actions(empty), id_col), id_col)
    shape.write.mode("overwrite").parquet(f"{path}/detections/batch=-1")
    spark.createDataFrame([], _LOG).write.mode("overwrite").json(f"{path}/log/batch=-1")
    docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(shape.schema).parquet(f"{path}/detections").select(*shape.columns), spark.read.schema(_LOG).json(f"{path}/log").select(*_LOG_NAMES)


_LOG_NAMES = [part.split()[0] for part in _LOG.split(", ")]


def type_counts(docs: DataFrame, ts: str, strings: list[str], *, id_col: str = "doc_id", text_col: str = "text", every: str = "1 hour", late: str = "10 seconds") -> DataFrame:
    """(window_start, type, n): card numbers, service keys and personal strings by tumbling windows of a stream, in append mode.

    A window is put out when the watermark, ``late`` behind the newest document,
    has passed its end; documents that come after that are not counted. Finding
    them is a projection of each document, so that only counts are shuffled.
    """
    timed = docs.withWatermark(ts, late)
    found = {
        "credit_card": cards.candidates(timed, id_col, text_col, keep=(ts,)).where(X.luhn_ok(F.col("number"))),
        "api_key": api_keys.first_matches(timed, id_col, text_col, keep=(ts,)),
        "personal_string": personal.exact(timed, personal.usable(strings), id_col, text_col, keep=(ts,)),
    }
    rows = None
    for name, part in found.items():
        own = part.select(F.col(ts), F.lit(name).alias("type"))
        rows = own if rows is None else rows.union(own)
    counted = rows.groupBy(F.window(ts, every).alias("window"), "type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "type", "n")
