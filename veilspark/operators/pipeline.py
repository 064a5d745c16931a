"""From detector outputs to actions: union, thresholds, overlap merge, order, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial

BLUR, WARN = 0.8, 0.6
REGISTRY = ("seed_phrase", "credit_card", "crypto_address", "personal_string", "api_key")


def union(parts: list[DataFrame]) -> DataFrame:
    """All detections; det_ord is the registry's order, then each detector's own."""
    both = reduce(DataFrame.unionByName, parts)
    place = F.array_position(F.array(*[F.lit(t) for t in REGISTRY]), F.col("type"))
    rank = F.when(place > 0, place).otherwise(len(REGISTRY) + 1)  # the caller's own come last
    return both.withColumn("det_ord", F.shiftleft(rank.cast("long"), 40) + F.col("part")).drop("part")


def action(confidence: Column, blur: float = BLUR, warn: float = WARN) -> Column:
    return F.when(confidence >= blur, "blur").when(confidence >= warn, "warn").otherwise("ignore")


def with_actions(dets: DataFrame, blur: float = BLUR, warn: float = WARN) -> DataFrame:
    return dets.withColumn("action", action(F.col("confidence"), blur, warn)).where("action <> 'ignore'")


def merge_overlaps(dets: DataFrame, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Greedy leaders in det_ord: a box joins the first leader it overlaps; the most confident member stays, first on ties."""
    return spatial.merged(dets, id_col, "det_ord", "confidence", threshold)


def ranked(dets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rank 1 is the most confident detection of a document; order of detection on ties."""
    w = Window.partitionBy(id_col).orderBy(F.desc("confidence"), "det_ord")
    return dets.withColumn("rank", F.row_number().over(w).cast("long"))


def summary(docs: DataFrame, dets: DataFrame, id_col: str = "doc_id", text_col: str = "text", detectors: int = len(REGISTRY)) -> DataFrame:
    """One row per document, also of those without tokens or detections."""
    line = F.btrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    n = F.when(line == "", 0).otherwise(F.size(F.split(line, " "))).cast("long")
    found = dets.groupBy(id_col).agg(F.count("*").alias("n_detections"), F.max(F.col("action") == "blur").alias("has_critical"), F.max(F.col("action") == "warn").alias("has_warnings"))
    return docs.select(F.col(id_col), n.alias("total_tokens")).join(found, id_col, "left").select(
        id_col,
        "total_tokens",
        F.lit(detectors).cast("long").alias("detectors_run"),
        F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
        F.coalesce("has_critical", F.lit(False)).alias("has_critical"),
        F.coalesce("has_warnings", F.lit(False)).alias("has_warnings"),
    )


def to_rows(dets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Detections in the form of a report: type, confidence, preview, box as one array, action and metadata, never null."""
    empty = F.create_map().cast("map<string,string>")
    return dets.select(id_col, "type", "confidence", F.col("preview").alias("text_preview"), F.array("x", "y", "w", "h").alias("bounding_box"), "action", F.coalesce("metadata", empty).alias("metadata"))


def log_rows(dets: DataFrame, sanitized: bool = True) -> DataFrame:
    """Rows of the detection log; previews are redacted unless told otherwise."""
    return dets.select(
        "type", "confidence", F.when(F.lit(sanitized), "[REDACTED]").otherwise(F.col("preview")).alias("text"),
        F.array("x", "y", "w", "h").alias("bounding_box"), "action",
    )
