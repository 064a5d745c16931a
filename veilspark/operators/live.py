"""Protective holds as a client lives through them: triggers, returns by hand and scenes in one order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of marks, in the order in which those of one instant count.
TRIGGER, RETURN, SCENE = 0, 1, 2


def marks(events: DataFrame, key: str, ts: str, trigger: Column, manual: Column, scene: Column) -> DataFrame:
    """(key, ts, kind, scene): the rows that matter to holds; one that is a trigger is nothing else.

    ``trigger`` and ``manual`` are conditions, ``scene`` is the scene that a row
    shows or null. Rows without a time go.
    """
    kind = F.when(trigger, TRIGGER).when(manual, RETURN).when(scene.isNotNull(), SCENE)
    return events.select(key, ts, kind.alias("kind"), F.when(kind == SCENE, scene).alias("scene")).where(F.col("kind").isNotNull() & F.col(ts).isNotNull())


def holds(marks_: DataFrame, key: str, ts: str, hold: str, *, auto_return: bool = True, privacy: str | None = None) -> DataFrame:
    """(key, hold_start, hold_end, n_triggers, early, return_scene), one row for each hold.

    The first trigger opens a hold and remembers the last scene shown outside of
    holds, which is the one to return to (``privacy`` itself is never remembered;
    null where there was none). Each trigger starts the time anew; the hold ends
    ``hold`` after its last trigger, a trigger at that very instant included, or
    at a return by hand before that (``early``). A trigger after a return opens
    the next hold. Without ``auto_return`` only a return ends a hold; one that
    nothing ended has no hold_end. Scenes shown inside a hold are not remembered,
    since the client goes back to the one before. Of marks at one instant
    triggers count first, then returns, then scenes in order of name. Rows
    without a time do not count; those without a key are a stream of their own.

    Windows over the marks of a key, one shuffle: a key with a third of all
    rows is one sort in one task, which spills.
    """
    order = Window.partitionBy(key).orderBy(ts, "kind", "scene")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.col(ts)), ignorenulls=True).over(before)
    span = F.expr(f"INTERVAL {hold}")
    fresh = F.col("shot").isNull() | F.coalesce(F.col("back") >= F.col("shot"), F.lit(False))
    if auto_return:
        fresh |= F.col("shot") + span < F.col(ts)
    number = F.sum(F.when((F.col("kind") == TRIGGER) & fresh, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    timed = marks_.where(F.col(ts).isNotNull())
    dealt = timed.withColumns({"shot": last(TRIGGER), "back": last(RETURN)}).withColumn("number", number)
    # a return belongs to the hold before it, whose triggers all come first
    per_hold = Window.partitionBy(key, "number")
    own = lambda kind: F.when(F.col("kind") == kind, F.col(ts))
    due = F.max(own(TRIGGER)).over(per_hold) + span if auto_return else F.lit(None).cast(marks_.schema[ts].dataType)
    dealt = dealt.withColumns({"start": F.min(own(TRIGGER)).over(per_hold), "due": due, "cut": F.min(own(RETURN)).over(per_hold)})
    dealt = dealt.withColumn("ending", F.least("due", "cut"))
    outside = (F.col("number") == 0) | (F.col(ts) >= F.col("ending"))
    seen = F.when((F.col("kind") == SCENE) & outside & ~F.col("scene").eqNullSafe(F.lit(privacy)), F.col("scene"))
    known = dealt.withColumn("seen", seen).withColumn("return_scene", F.last("seen", ignorenulls=True).over(before))
    opening = (F.col("kind") == TRIGGER) & (F.col("number") > 0)
    # between the triggers of a hold no scene is seen, so that all its rows know the same one
    triggers = known.where(opening).groupBy(key, "number").agg(
        F.first("start").alias("hold_start"), F.first("ending").alias("hold_end"), F.count("*").alias("n_triggers"),
        F.first(F.coalesce(F.col("cut") < F.col("due"), F.col("cut").isNotNull() if not auto_return else F.lit(False))).alias("early"),
        F.first("return_scene").alias("return_scene"),
    )
    return triggers.drop("number")
