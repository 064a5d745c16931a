"""Runs of dictionary words that look like a recovery phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout

MAX_GAP = 50


def dictionary(docs: DataFrame, text_col: str = "text", size: int = 2048) -> DataFrame:
    """(word, n, rank): the ``size`` most frequent a-z words of 3 to 8 letters; ties by the alphabet."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(layout.AZ_WORD.replace("++", "{3,8}+")), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long"))


def from_file(spark, path: str, size: int = 2048) -> DataFrame:
    """A word list, one word a line; its number of distinct words must be ``size``."""
    words = spark.read.text(path).select(F.lower(F.btrim("value")).alias("word")).where("word <> ''").distinct()
    n = words.count()
    if n != size:
        raise ValueError(f"{path} has {n} words, not {size}")
    return words


def confidence(n: Column) -> Column:
    return (
        F.when(n.isin(12, 24), 0.95)
        .when(n.between(10, 14) | n.between(22, 26), 0.80)
        .when(n.between(15, 21), 0.70)
        .otherwise(0.60)
    )


def word_hits(toks: DataFrame, words: DataFrame) -> DataFrame:
    """Words of the list; a list as small as it should be is sent to all workers by the planner, a large one is not."""
    return layout.split_words(toks).join(words.select("word"), "word", "left_semi")


def detect(toks: DataFrame, words: DataFrame, id_col: str = "doc_id", *, min_words: int = 12) -> DataFrame:
    """One row per run of at least ``min_words`` dictionary words; other words between them do not break it."""
    if min_words not in (12, 24):
        raise ValueError("min_words must be 12 or 24")
    # numbers in place of words, and places as one number, are what a hash aggregate takes; laid out tokens of a line go by ord
    # the filter that the first join asks for, so that the list is the same plan for all three and made once
    numbered = words.select("word").where("word IS NOT NULL").distinct().withColumn("code", F.row_number().over(Window.orderBy("word")))
    place = F.shiftleft(F.col("ord").cast("long"), 31) + F.col("sub") if "line_no" in toks.columns else F.struct("x", "ord", "sub")
    hits = layout.split_words(toks).join(numbered, "word")
    # words of one height cannot break a run, so that a line is one row before anything is shuffled
    lines = hits.groupBy(id_col, "y").agg(F.count("*").alias("n"), F.min_by("code", place).alias("head"), F.max_by("code", place).alias("tail"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("low"))
    w = Window.partitionBy(id_col).orderBy("y")
    gap = F.col("y") - F.lag("y").over(w) > MAX_GAP
    lines = lines.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    found = lines.groupBy(id_col, "run").agg(
        F.sum("n").alias("word_count"), F.min_by("head", "y").alias("__first"), F.max_by("tail", "y").alias("__last"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("right") - F.min("x")).alias("w"), (F.max("low") - F.min("y")).alias("h"),
    ).where(F.col("word_count") >= min_words)
    for end in ("first", "last"):
        found = found.join(numbered.select(F.col("code").alias(f"__{end}"), F.col("word").alias(end)), f"__{end}")
    n = F.col("word_count")
    return found.select(
        id_col,
        F.col("run").alias("part"),
        F.lit("seed_phrase").alias("type"),
        confidence(n).alias("confidence"),
        F.concat("first", F.lit("..."), "last").alias("preview"),
        "x", "y", "w", "h",
        F.create_map(F.lit("word_count"), n.cast("string"), F.lit("expected_count"), F.when(n <= 15, "12").otherwise("24"), F.lit("all_words_valid"), F.lit("true")).alias("metadata"),
    )
