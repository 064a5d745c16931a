"""User-given strings in texts: exact or fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import geometry as G
from ..functions import text as X
from . import layout

MAX_FREE, THRESHOLD = 3, 85.0


def usable(strings: list[str], max_free: int | None = MAX_FREE) -> list[str]:
    """The first ``max_free`` strings, without blank ones."""
    return [s for s in (strings if max_free is None else strings[:max_free]) if s.strip()]


def _hits(text: Column, strings: list[str]) -> Column:
    """Array of (part, string, score 100) of the strings that a text contains, ignoring case; the words of a string alone
    rule most texts out before white space is looked at."""
    line = F.lower(X.one_line(text))
    hits = []
    for k, s in enumerate(strings):
        words = F.lit(True)
        for word in s.lower().split():
            words = words & F.lower(text).contains(word)
        hits.append(F.when(words & line.contains(s.lower()), F.struct(F.lit(k).cast("long").alias("part"), F.lit(s).alias("string"), F.lit(100.0).alias("score"))))
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def exact(docs: DataFrame, strings: list[str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, part, string, score): score 100 where the text contains the string, ignoring case; with the columns to ``keep``."""
    return docs.select(F.col(id_col), *keep, F.explode(_hits(F.col(text_col), strings)).alias("m")).select(id_col, *keep, "m.*")


def approximate(docs: DataFrame, strings: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    base = docs.select(F.col(id_col), X.one_line(F.col(text_col)).alias("line"))
    return fuzzy.scored(base, strings, id_col, "line", threshold)


def _places(toks: DataFrame, id_col: str) -> DataFrame:
    """(id, part, string, score, b) of exact matches: the first token that contains the string, else the first token."""
    pairs = toks.select("*", F.explode("found").alias("m")).select(id_col, "m.*", "ord", "text", "x", "y", "w", "h")
    hit = F.lower("text").contains(F.lower("string"))
    place = F.min_by(F.struct("x", "y", "w", "h"), F.struct(F.when(hit, 0).otherwise(1), "ord"))
    return pairs.where(hit | (F.col("ord") == 0)).groupBy(id_col, "part", "string", "score").agg(place.alias("b"))


def _fuzzy_places(toks: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """As ``_places`` by likeness: around the tokens that are most like the string, else the first most like pair of
    neighbours, else the first token."""
    after = F.lead(F.struct("text", "x", "y", "w", "h")).over(Window.partitionBy(id_col).orderBy("ord"))
    pairs = toks.select("*", after.alias("next")).select("*", F.explode("found").alias("m")).select(id_col, "m.*", "ord", "text", "x", "y", "w", "h", "next")
    one = fuzzy.partial_udf(threshold)("string", "text")
    two = fuzzy.partial_udf(threshold)("string", F.concat_ws(" ", "text", "next.text"))
    scored = pairs.withColumns({"one": one, "two": F.when(F.col("next").isNotNull(), two)})
    keys = [id_col, "part", "string", "score"]
    best = Window.partitionBy(*keys)
    scored = scored.withColumns({"best": F.max("one").over(best), "best2": F.max("two").over(best)})
    single, double = F.col("best") >= threshold, F.col("best2") >= threshold
    chosen = F.when(single, F.col("one") == F.col("best")).when(double, F.col("two") == F.col("best2")).otherwise(F.col("ord") == 0)
    rows = scored.where(chosen).withColumn("kind", F.when(single, 1).when(double, 2).otherwise(0))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) == 1
    rows = rows.withColumn("first", first).where((F.col("kind") == 1) | F.col("first"))
    boxes = F.when(F.col("kind") == 2, F.array(F.struct("x", "y", "w", "h"), F.struct("next.x", "next.y", "next.w", "next.h"))).otherwise(F.array(F.struct("x", "y", "w", "h")))
    each = rows.select(*keys, F.explode(boxes).alias("e")).select(*keys, "e.x", "e.y", "e.w", "e.h")
    return each.groupBy(*keys).agg(*G.merged()).select(*keys, F.struct("x", "y", "w", "h").alias("b"))


def detect(docs: DataFrame, strings: list[str], id_col: str = "doc_id", text_col: str = "text", *, fuzzy_match: bool = False, threshold: float = THRESHOLD, max_free: int | None = MAX_FREE) -> DataFrame:
    """Detections of the strings; exact ones are placed at a token that contains them, fuzzy ones where the likeness is."""
    strings = usable(strings, max_free)
    text = F.col(text_col)
    if fuzzy_match:
        found, given = fuzzy.matches(F.col("__line"), strings, threshold), docs.withColumn("__line", X.one_line(text))
        if not strings:
            given = given.where("false")
    else:
        found, given = _hits(text, strings), docs
    # what was found goes along with its document, which is read once and joined with nothing
    some = given.select(F.col(id_col), text, X.only_if(found, lambda m: F.size(m) > 0).alias("found"))
    toks = layout.tokens(some, id_col, text_col, keep=("found",))
    best = _fuzzy_places(toks, id_col, threshold) if fuzzy_match else _places(toks, id_col)
    return best.select(
        id_col,
        "part",
        F.lit("personal_string").alias("type"),
        (F.col("score") / 100).alias("confidence"),
        X.mask(F.col("string")).alias("preview"),
        "b.x", "b.y", "b.w", "b.h",
        F.create_map(F.lit("match_score"), F.col("score").cast("string"), F.lit("string_type"), X.classify_personal(F.col("string")), F.lit("fuzzy_threshold"), F.lit(str(threshold))).alias("metadata"),
    )
