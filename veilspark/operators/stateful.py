"""Change gates, protective holds, pauses and counters over ordered rows, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_gate(frames: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """changed: a stream's first frame, or one that differs from the frame just before it."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    return frames.withColumn("changed", first | ~F.col(value).eqNullSafe(before))


def sample(frames: DataFrame, key: str, ts: str, per_second: float) -> DataFrame:
    """The first frame of each interval of ``1 / per_second`` seconds."""
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 * per_second)
    w = Window.partitionBy(key, bucket).orderBy(ts)
    return frames.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def holds(triggers: DataFrame, key: str, ts: str, hold: str) -> DataFrame:
    """(key, hold_start, hold_end, n_triggers): each trigger restarts the hold, which ends ``hold`` after the last one."""
    s = triggers.groupBy(key, F.session_window(ts, hold).alias("s")).agg(F.count("*").alias("n_triggers"))
    return s.select(key, F.col("s.start").alias("hold_start"), F.col("s.end").alias("hold_end"), "n_triggers")


def open_holds(triggers: DataFrame, key: str, ts: str) -> DataFrame:
    """As ``holds`` without an automatic return: the first trigger opens one hold, which no time ends."""
    s = triggers.where(F.col(ts).isNotNull()).groupBy(key).agg(F.min(ts).alias("hold_start"), F.count("*").alias("n_triggers"))
    return s.select(key, "hold_start", F.lit(None).cast(triggers.schema[ts].dataType).alias("hold_end"), "n_triggers")


def scene_actions(holds_: DataFrame, key: str, privacy: str, scene: str = "return_scene") -> DataFrame:
    """(key, at, action, scene): the switches that holds with a scene to return to ask for, in a form that any client can play."""
    start = F.struct(F.col("hold_start").alias("at"), F.lit("privacy").alias("action"), F.lit(privacy).alias("scene"))
    end = F.struct(F.col("hold_end").alias("at"), F.lit("return").alias("action"), F.col(scene).alias("scene"))
    # nothing is switched back where the hold does not end or no scene was known
    both = F.filter(F.array(start, end), lambda s: s["at"].isNotNull() & s["scene"].isNotNull())
    return holds_.select(key, F.explode(both).alias("s")).select(key, "s.*")


def early_return(holds_: DataFrame, manual: DataFrame, key: str, ts: str) -> DataFrame:
    """hold_end cut at the first manual return inside the hold, by a union in order of time and no range join."""
    w = Window.partitionBy(key).orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = manual.select(key, F.col(ts).alias("t"), F.lit(0).alias("kind"), F.col(ts).alias("m"), F.lit(None).cast(holds_.schema["hold_end"].dataType).alias("hold_end"), F.lit(None).cast("long").alias("n_triggers"))
    starts = holds_.select(key, F.col("hold_start").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(manual.schema[ts].dataType).alias("m"), "hold_end", "n_triggers")
    after = starts.unionByName(marks).withColumn("next", F.last("m", ignorenulls=True).over(w)).where("kind = 1")
    return after.select(key, F.col("t").alias("hold_start"), F.least("hold_end", "next").alias("hold_end"), "n_triggers", (F.col("next") < F.col("hold_end")).alias("early"))


def scene_before(events: DataFrame, holds_: DataFrame, key: str, ts: str, scene: str) -> DataFrame:
    """The last scene before each hold, the one to return to; null if there was none."""
    w = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select(key, F.col(ts).alias("t"), F.lit(1).alias("kind"), F.col(scene).alias("scene"))
    starts = holds_.select(key, F.col("hold_start").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("scene"))
    out = seen.unionByName(starts).withColumn("return_scene", F.last("scene", ignorenulls=True).over(w)).where("kind = 0")
    return out.select(key, F.col("t").alias("hold_start"), "return_scene")


def without_pauses(events: DataFrame, key: str, ts: str, order: str, pause: F.Column, resume: F.Column) -> DataFrame:
    """Rows while their stream is not paused; the switching rows themselves go."""
    state = F.when(pause, True).when(resume, False)
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("__switch", state).withColumn("__paused", F.coalesce(F.last("__switch", ignorenulls=True).over(w), F.lit(False)))
    return marked.where("NOT __paused AND __switch IS NULL").drop("__switch", "__paused")


def running_count(rows: DataFrame, key: str, order: list[str], n: str, name: str = "total") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(n).over(w))


def ui_state(connected: F.Column, blur: F.Column, warn: F.Column, started: F.Column | None = None) -> F.Column:
    """State to show; ``idle`` before anything was scanned, where ``started`` is given."""
    idle = F.when(~started, "idle") if started is not None else F
    return idle.when(~connected, "disconnected").when(blur, "alert").when(warn, "warn").otherwise("clean")
