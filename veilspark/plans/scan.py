"""The whole scan of a document table."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import api_keys, cards, crypto, layout, personal, pipeline, seeds
from .config import ScanConfig

Detector = Callable[[DataFrame], DataFrame]


def detectors(config: ScanConfig, words: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Detector] | None = None) -> dict[str, Detector]:
    """What the settings switch on, in registry order, and the caller's own: each a function from documents to detections
    (id, part, type, confidence, preview, x, y, w, h, metadata)."""
    found: dict[str, Detector] = {}
    if words is not None:
        found["seed_phrase"] = lambda docs: seeds.detect(layout.tokens(docs, id_col, text_col), words, id_col, min_words=config.min_word_count)
    found["credit_card"] = lambda docs: cards.detect(docs, id_col, text_col)
    found["crypto_address"] = lambda docs: crypto.detect(docs, id_col, text_col, config.networks)
    if config.strings:
        found["personal_string"] = lambda docs: personal.detect(docs, list(config.strings), id_col, text_col, fuzzy_match=config.fuzzy, threshold=config.fuzzy_threshold, max_free=config.max_free)
    if config.api_keys:
        found["api_key"] = lambda docs: api_keys.detect(docs, id_col, text_col)
    return found | (extra or {})


def run(docs: DataFrame, chosen: dict[str, Detector]) -> tuple[DataFrame, int]:
    """All detections, and how many detectors ran: one that cannot be planned is named in a warning and left out."""
    parts = []
    for name, detect in chosen.items():
        try:
            part = detect(docs)
            part.schema  # noqa: B018 - analysis is where a faulty detector fails
        except Exception:  # noqa: BLE001 - whatever is wrong with one, the others go on
            logging.getLogger(__name__).warning("detector %s failed and was left out", name, exc_info=True)
        else:
            parts.append(part)
    if not parts:
        raise ValueError("no detector could run")
    return pipeline.union(parts), len(parts)


def no_detections(spark: SparkSession, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """Detections of no detector, as ``pipeline.union`` has them."""
    rest = "type string, confidence double, preview string, x long, y long, w long, h long, metadata map<string,string>, det_ord long"
    return spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type), *T.StructType.fromDDL(rest).fields]))


def isolated(docs: DataFrame, chosen: dict[str, Detector], path: str, id_col: str = "doc_id") -> tuple[DataFrame, dict[str, str]]:
    """All detections, and what was wrong with the detectors that failed, be it when they were planned or on some row.

    Each detector's rows are saved below ``path`` before the next one runs, and
    only those of detectors that finished are read.
    """
    parts, failed = [], {}
    for name, detect in chosen.items():
        try:
            part = detect(docs)
            part.write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001 - whatever is wrong with one, the others go on
            logging.getLogger(__name__).warning("detector %s failed and was left out", name, exc_info=True)
            failed[name] = f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:500]
        else:
            parts.append(docs.sparkSession.read.schema(part.schema).parquet(f"{path}/{name}"))
    if not parts:
        return no_detections(docs.sparkSession, docs.schema[id_col].dataType, id_col), failed
    return pipeline.union(parts), failed


def raw_detections(docs: DataFrame, config: ScanConfig, words: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detections of all detectors that the settings switch on, in registry order."""
    return run(docs, detectors(config, words, id_col, text_col))[0]


def summary(docs: DataFrame, config: ScanConfig, words: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, with the number of detectors that ran."""
    raw, n = run(docs, detectors(config, words, id_col, text_col))
    return pipeline.summary(docs, pipeline.with_actions(raw, config.blur, config.warn), id_col, text_col, n)


def detections(docs: DataFrame, config: ScanConfig, words: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detections with actions, overlaps merged, ranked within each document."""
    acted = pipeline.with_actions(raw_detections(docs, config, words, id_col, text_col), config.blur, config.warn)
    return pipeline.ranked(pipeline.merge_overlaps(acted, id_col), id_col)


def top_action(dets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The detection that drives the action: rank 1 of documents with a blur."""
    return dets.where((F.col("rank") == 1) & (F.col("action") == "blur"))
