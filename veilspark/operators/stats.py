"""Counts, rates and percentiles of detections and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TP_LEAST, FP_MOST, P95_MOST_MS = 0.95, 0.05, 500.0


def log_counts(log: DataFrame) -> DataFrame:
    """(dimension, name, n): counts by type, by action and in total; a missing value is 'unknown'."""
    named = log.select(F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("action", F.lit("unknown")).alias("action"))
    sets = named.groupingSets([("type",), ("action",), ()], "type", "action").agg(F.count("*").alias("n"), F.grouping("type").alias("gt"), F.grouping("action").alias("ga"))
    return sets.select(
        F.when((F.col("gt") == 1) & (F.col("ga") == 1), "total").when(F.col("gt") == 0, "type").otherwise("action").alias("dimension"),
        F.coalesce("type", "action", F.lit("all")).alias("name"),
        "n",
    )


def rate(passed: Column, of: Column) -> Column:
    """Share of rows that pass among those that count, 0 without any."""
    n = F.count(F.when(of, 1))
    return F.when(n == 0, 0.0).otherwise(F.count(F.when(of & passed, 1)) / n)


#: Value ranges that a key's rows are counted in before any is sorted.
RANGES = 200


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], *, before: bool) -> DataFrame:
    """Values at exact positions of the sorted column, per key.

    ``before`` takes position ``max(0, int(n p) - 1)``, else ``min(int(n p), n - 1)``.
    Rows are counted by ranges of values, whose bounds come from an approximate
    pass and only decide how the work is dealt; then the distinct values of just
    the range that holds a position are counted and walked through.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    cuts = sorted(set(known.agg(F.percentile_approx("v", [j / RANGES for j in range(1, RANGES)], 1000)).first()[0] or []))
    # a sum of comparisons and no lambda, whose variables the optimiser loses where it infers a filter for the join below
    dealt = known.withColumn("b", sum((F.when(F.col("v") >= c, 1).otherwise(0) for c in cuts), F.lit(0)))
    by_key = Window.partitionBy("k").orderBy("b")
    sized = dealt.groupBy("k", "b").agg(F.count("*").alias("n"))
    sized = sized.withColumns({"start": F.coalesce(F.sum("n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("k"))})

    def at(p: float) -> Column:
        return F.greatest(F.floor(F.col("all") * F.lit(p)) - 1, F.lit(0)) if before else F.least(F.floor(F.col("all") * F.lit(p)), F.col("all") - 1)

    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(p).alias("at")) for name, p in shares.items()]))
    places = sized.select("k", "b", "n", "start", wanted.alias("w")).where("w.at >= start AND w.at < start + n").select(F.col("k").alias("pk"), F.col("b").alias("pb"), "w.name", (F.col("w.at") - F.col("start")).alias("offset"))
    same = F.col("k").eqNullSafe(F.col("pk")) & (F.col("b") == F.col("pb"))  # rows with a null key are a key of their own
    few = dealt.join(places.select("pk", "pb").distinct(), same, "left_semi").groupBy("k", "b", "v").agg(F.count("*").alias("n"))
    within = Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    reached = few.withColumn("end", F.sum("n").over(within))
    found = reached.join(places, same).where("offset >= end - n AND offset < end")
    return found.groupBy(F.col("k").alias(key)).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, runs, avg, min, max) of the values that are not null."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.count(v).alias("runs"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"))


def session_totals(scans: DataFrame, key: str, detections: str = "n_detections") -> DataFrame:
    """(key, frames, detections): what a session has scanned and found when it ends."""
    return scans.groupBy(key).agg(F.count("*").alias("frames"), F.coalesce(F.sum(detections), F.lit(0)).cast("long").alias("detections"))


def word_overlap(expected: Column, found: Column) -> Column:
    """Share of the expected text's distinct words that the found text has; 0 without words."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    n = F.size(words(expected))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(words(expected), words(found))) / n)


def verdict(tp: Column, fp: Column, p95: Column) -> Column:
    return (tp >= TP_LEAST) & (fp <= FP_MOST) & (p95 <= P95_MOST_MS)


def recommendation(p95: Column) -> Column:
    return F.when(p95 < 300, "excellent").when(p95 < 500, "good").otherwise("marginal")
