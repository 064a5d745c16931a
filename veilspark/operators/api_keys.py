"""Service keys: the first pattern of each service that a text matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.patterns import BUILT_IN, KeyPattern
from . import layout


def first_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: tuple[KeyPattern, ...] = BUILT_IN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, part, service, description, confidence, match): at most one row per service and text, with the columns to ``keep``."""
    return _marked(docs, text_col, catalog).select(F.col(id_col), *keep, F.explode("found").alias("m")).select(id_col, *keep, "m.*")


def _marked(docs: DataFrame, text_col: str, catalog: tuple[KeyPattern, ...]) -> DataFrame:
    """The rows of texts with a match, and ``found``, an array of them."""
    options = []
    for k, service in enumerate(dict.fromkeys(p.service for p in catalog)):
        pick = None
        for p in (p for p in catalog if p.service == service):
            match = F.regexp_extract("line", p.pattern, 0)
            row = F.struct(F.lit(k).cast("long").alias("part"), F.lit(service).alias("service"), F.lit(p.description).alias("description"), F.lit(p.confidence).alias("confidence"), match.alias("match"))
            # looking for a fixed text is far quicker than a pattern that is tried at every place
            hit = F.col("line").contains(p.needs) & (match != "") if p.needs else match != ""
            pick = F.when(hit, row) if pick is None else pick.when(hit, row)
        options.append(pick)
    hits = F.filter(F.array(*options), lambda h: h.isNotNull())
    return docs.withColumn("line", X.one_line(F.col(text_col))).select(*docs.columns, X.only_if(hits, lambda h: F.size(h) > 0).alias("found"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: tuple[KeyPattern, ...] = BUILT_IN) -> DataFrame:
    """Placed at the first token with the first 8 characters of the match, else at the first token."""
    toks = layout.tokens(_marked(docs, text_col, catalog), id_col, text_col, keep=("found",))
    pairs = toks.select("*", F.explode("found").alias("m")).select(id_col, "m.part", "m.service", "m.description", F.col("m.confidence").alias("confidence"), "m.match", "ord", "text", "x", "y", "w", "h")
    hit = F.col("text").contains(F.left("match", F.lit(8)))
    place = F.min_by(F.struct("x", "y", "w", "h"), F.struct(F.when(hit, 0).otherwise(1), "ord"))
    best = pairs.where(hit | (F.col("ord") == 0)).groupBy(id_col, "part", "service", "description", "confidence").agg(place.alias("b"))
    return best.select(
        id_col,
        "part",
        F.lit("api_key").alias("type"),
        "confidence",
        X.short_preview(F.concat(F.lit("["), "service", F.lit("] "), "description")).alias("preview"),
        "b.x", "b.y", "b.w", "b.h",
        F.create_map(F.lit("service"), F.col("service"), F.lit("description"), F.col("description")).alias("metadata"),
    )
