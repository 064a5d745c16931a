"""Queries of live holds, the streaming scan, and the functions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import live, seeds, stateful
from ..streaming import actions as sink
from ..streaming import live as streaming
from ..streaming import loop, scan_stream, scans
from . import scan
from .catalog_base import CONFIG, STRINGS, docs_of, customer_text, stream_of, stream_root, table


def _marks(events: DataFrame) -> DataFrame:
    """Errors as triggers, logins as returns by hand, whatever else is shown as scenes."""
    kind = F.col("event_type")
    return live.marks(events, "user_id", "ts", kind == "error", kind == "login", kind)


def live_holds(spark: SparkSession, d: str) -> DataFrame:
    return live.holds(_marks(table(spark, d, "events")), "user_id", "ts", "24 hours")


def live_open_holds(spark: SparkSession, d: str) -> DataFrame:
    """Without an automatic return: logins alone end holds."""
    return live.holds(_marks(table(spark, d, "events")), "user_id", "ts", "24 hours", auto_return=False)


def _stream_holds(spark: SparkSession, d: str) -> DataFrame:
    return streaming.holds(_marks(stream_of(spark, d, "events")), "user_id", "ts", "24 hours")


def stream_live_holds(spark: SparkSession, d: str) -> DataFrame:
    root = stream_root(spark, "live-holds")
    return scans.to_table(_stream_holds(spark, d), f"{root}/out", f"{root}/state")


def stream_scene_actions(spark: SparkSession, d: str) -> DataFrame:
    """Switches of the live holds that are over, played by a client that takes them all."""
    root = stream_root(spark, "scene-actions")
    switches = stateful.scene_actions(_stream_holds(spark, d), "user_id", "privacy")
    return sink.play(switches, "user_id", sink.SilentClient, f"{root}/out", f"{root}/state")


def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """All detections of the stream of documents; the dictionary is that of the table."""
    root = stream_root(spark, "scan")
    chosen = scan.detectors(CONFIG, seeds.dictionary(docs_of(spark, d)))
    found, _ = scan_stream.detections(stream_of(spark, d, "documents"), chosen, root, f"{root}/state")
    return found.select("doc_id", "type", "confidence", "preview", *[F.col(c).cast("long").alias(c) for c in "xywh"], "action", "rank")


def stream_scan_log(spark: SparkSession, d: str) -> DataFrame:
    """Rows, detections and detectors of all micro-batches of the streaming scan without the dictionary."""
    root = stream_root(spark, "scan-log")
    _, log = scan_stream.detections(stream_of(spark, d, "documents"), scan.detectors(CONFIG), root, f"{root}/state")
    return log.agg(F.sum("rows").alias("n_rows"), F.sum("detections").alias("n_detections"), F.max("detectors_run").alias("detectors_run"), F.max("failed").alias("failed"))


def stream_loop(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as frames: gate, all detectors but the dictionary's, and what to show."""
    root = stream_root(spark, "loop")
    frames = stream_of(spark, d, "conversations").select("conv_id", "turn", "text")
    states, _, _ = loop.Loop(root, scan.detectors(CONFIG, id_col="frame"), "conv_id", "turn").run(frames, f"{root}/state")
    return states.groupBy("conv_id").agg(
        F.count("*").alias("n_frames"), F.count(F.when(F.col("changed"), 1)).alias("n_changed"), F.coalesce(F.sum("n_detections"), F.lit(0)).alias("n_detections"), F.count(F.when(F.col("state") == "alert", 1)).alias("n_alerts")
    )


def _minute(doc_id: Column) -> Column:
    """Documents come a minute apart."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + doc_id * 60)


def stream_type_counts(spark: SparkSession, d: str) -> DataFrame:
    root = stream_root(spark, "type-counts")
    docs = stream_of(spark, d, "documents").withColumn("ts", _minute(F.col("doc_id")))
    counts = scans.to_table(scan_stream.type_counts(docs, "ts", list(STRINGS)), f"{root}/out", f"{root}/state")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def sql_scalars(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    customers = table(spark, d, "customer").select("c_custkey", customer_text().alias("given"), F.concat(F.lpad(F.col("c_custkey").cast("string"), 4, "4"), F.lit("11l1 11II 1O")).alias("number"))
    return spark.sql(
        """SELECT c_custkey, classify_string(given) AS kind, mask_string(given) AS masked, card_network(number) AS network,
                  repair_digits(number) AS repaired, luhn_ok(repair_digits(number) || '1') AS valid, one_line(' ' || given || '  x ') AS line
           FROM {customers}""",
        customers=customers,
    )


def sql_findings(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    return spark.sql(
        "SELECT doc_id, f.* FROM (SELECT doc_id, findings(text) AS every FROM {docs}) LATERAL VIEW explode(every) AS f",
        docs=docs_of(spark, d),
    )


QUERIES = {f.__name__: f for f in (live_holds, live_open_holds, stream_live_holds, stream_scene_actions, stream_scan, stream_scan_log, stream_loop, stream_type_counts, sql_scalars, sql_findings)}
