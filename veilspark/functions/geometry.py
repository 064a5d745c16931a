"""Column functions on boxes (x, y, w, h in pixels, w and h not negative)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in "xywh")


def center(b: Box) -> tuple[Column, Column]:
    x, y, w, h = b
    return x + F.floor(w / 2), y + F.floor(h / 2)


def area(b: Box) -> Column:
    return b[2] * b[3]


def distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def vertical_distance(a: Box, b: Box) -> Column:
    """Positive where b is below a."""
    return b[1] - a[1]


def same_line(a: Box, b: Box, threshold: int = 10) -> Column:
    return F.abs(b[1] - a[1]) <= threshold


def iou_at_least(a: Box, b: Box, threshold: float = 0.5) -> Column:
    iw = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    ih = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    inter = iw * ih
    union = area(a) + area(b) - inter
    return (iw > 0) & (ih > 0) & (union > 0) & (inter >= F.lit(threshold) * union)


def clustered(order: Column, y: Column, max_distance: int = 50) -> Column:
    """Aggregate: whether no two neighbours in ``order`` are more than ``max_distance`` apart vertically; true for a single box."""
    ys = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), y.alias("y")))), lambda s: s["y"])
    steps = F.zip_with(F.slice(ys, 1, F.size(ys) - 1), F.slice(ys, 2, F.size(ys)), lambda a, b: F.abs(b - a))
    return F.forall(F.when(F.size(ys) > 1, steps).otherwise(F.array().cast("array<bigint>")), lambda d: d <= max_distance)


def merged(prefix: str = "") -> list[Column]:
    """Aggregates of the enclosing box."""
    x, y, w, h = box(prefix)
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("w"), (F.max(y + h) - F.min(y)).alias("h")]
