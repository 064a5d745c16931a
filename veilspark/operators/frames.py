"""Pixel operators on frames of raw bytes (height, width, channels), by NumPy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

_KERNEL = np.array([1, 4, 6, 4, 1], np.float64) / 16
PIXEL_CHANGE, FRAME_CHANGE = 25, 0.02


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def invert_if_dark(frame: np.ndarray) -> np.ndarray:
    """Negative of a frame whose first channel has a mean under 127."""
    return 255 - frame if frame[..., 0].mean() < 127 else frame


def gray(frame: np.ndarray) -> np.ndarray:
    if frame.shape[2] == 1:
        return frame[..., 0]
    return np.clip(np.rint(frame[..., :3] @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def _blur(a: np.ndarray) -> np.ndarray:
    p = np.pad(a.astype(np.float64), 2, mode="reflect" if min(a.shape) > 2 else "edge")
    p = sum(k * p[i : i + a.shape[0]] for i, k in enumerate(_KERNEL))
    return np.rint(sum(k * p[:, i : i + a.shape[1]] for i, k in enumerate(_KERNEL)))


def change_mask(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _blur(np.abs(a.astype(int) - b.astype(int))) > PIXEL_CHANGE


def change_fraction(a: np.ndarray, b: np.ndarray) -> float:
    m = change_mask(a, b)
    return float(m.mean()) if m.size else 0.0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each stretch of set pixels, row by row."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def changed_regions(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of 8-connected areas with at least max(100, 1/10000 of the frame) pixels, by their pixel count.

    Stretches of set pixels are joined with those that they touch in the row
    above, in one pass; a second pass adds up what belongs together. The time
    follows the number of stretches, whatever the areas' shapes.
    """
    least = max(100, mask.size // 10_000)
    row, first, last = _runs(mask)
    parent = list(range(len(row)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    width = mask.shape[1] + 2
    # places on one line of all rows, so that one search finds the stretches above that are touched, corners included
    above = np.searchsorted(row * width + last, (row - 1) * width + first - 1, side="left")
    beyond = np.searchsorted(row * width + first, (row - 1) * width + last + 1, side="right")
    for k, (lo, hi) in enumerate(zip(above.tolist(), beyond.tolist(), strict=True)):
        for j in range(lo, hi):
            a, b = root(j), root(k)
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(k) for k in range(len(row))], np.int64)
    names, own = np.unique(roots, return_inverse=True)
    count = np.bincount(own, last - first + 1, len(names))
    box = [np.full(len(names), v, np.int64) for v in (mask.shape[1], mask.shape[0], -1, -1)]
    np.minimum.at(box[0], own, first)
    np.minimum.at(box[1], own, row)
    np.maximum.at(box[2], own, last)
    np.maximum.at(box[3], own, row)
    big = np.flatnonzero(count >= least)
    out = [(int(x), int(y), int(u - x + 1), int(v - y + 1)) for x, y, u, v in zip(*[b[big] for b in box], strict=True)]
    return sorted(out, key=lambda b: (b[1], b[0]))


REGIONS = "array<struct<x:int,y:int,w:int,h:int>>"


def region_frames(images: DataFrame, key: str, order: str) -> DataFrame:
    """Images (height, width, nChannels, data) with ``regions``: the boxes that changed since the frame before of their stream.

    A first frame, and one of another shape than the one before, have none
    (null), as there is nothing to compare them with.
    """
    w = Window.partitionBy(key).orderBy(order)
    shape = F.struct("height", "width", "nChannels")
    before = images.withColumns({"__data": F.lag("data").over(w), "__shape": F.lag(shape).over(w)})

    def run(now: pd.Series, then: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for a, b, h, w, c in zip(now, then, height, width, channels, strict=True):
            boxes = None if b is None else changed_regions(change_mask(gray(pixels(a, h, w, c)), gray(pixels(b, h, w, c))))
            out.append(boxes if boxes is None else [dict(zip("xywh", box, strict=True)) for box in boxes])
        return pd.Series(out, dtype=object)

    same = F.col("__shape").eqNullSafe(shape) & F.col("__data").isNotNull()
    found = pandas_udf(run, REGIONS)("data", F.when(same, F.col("__data")), "height", "width", "nChannels")
    return before.withColumn("regions", F.when(same, found)).drop("__data", "__shape")


def fraction_udf(height: int, width: int, channels: int):
    """Column function (data, data before) -> changed share of the gray frames; 1.0 without one before."""

    def run(now: pd.Series, before: pd.Series) -> pd.Series:
        size = height * width * channels
        out = []
        for a, b in zip(now, before, strict=True):
            if b is None or len(a) != size or len(b) != size:
                out.append(1.0)
            else:
                out.append(change_fraction(gray(pixels(a, height, width, channels)), gray(pixels(b, height, width, channels))))
        return pd.Series(out, dtype=float)

    return pandas_udf(run, "double")


def invert_udf(height: int, width: int, channels: int):
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: invert_if_dark(pixels(d, height, width, channels)).tobytes())

    return pandas_udf(run, "binary")


def tall_fraction_udf(width: int, channels: int, pad: bytes = b" "):
    """As ``fraction_udf`` for frames whose height follows their data; the shorter of a pair is padded to the longer."""

    def run(now: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(now, before, strict=True):
            if b is None:
                out.append(1.0)
            else:
                height = -(-max(len(a), len(b)) // (width * channels))
                a, b = (pixels(x.ljust(height * width * channels, pad), height, width, channels) for x in (a, b))
                out.append(change_fraction(gray(a), gray(b)))
        return pd.Series(out, dtype=float)

    return pandas_udf(run, "double")


def tall_invert_udf(width: int, channels: int):
    """As ``invert_udf`` for frames of whole rows whose height follows their data."""

    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: invert_if_dark(pixels(d, len(d) // (width * channels), width, channels)).tobytes())

    return pandas_udf(run, "binary")


def gate_frames(images, key: str, order: str, reset=None):
    """changed, of images (height, width, nChannels, data): a stream's first frame, one of another shape than the one before,
    one after a ``reset``, or one that differs in ``FRAME_CHANGE`` of its pixels or more."""
    w = Window.partitionBy(key).orderBy(order)
    shape = F.struct("height", "width", "nChannels")
    before = images.withColumns({"__data": F.lag("data").over(w), "__shape": F.lag(shape).over(w)})

    def run(now: pd.Series, then: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        rows = zip(now, then, height, width, channels, strict=True)
        return pd.Series([change_fraction(gray(pixels(a, h, w, c)), gray(pixels(b, h, w, c))) if b is not None else 1.0 for a, b, h, w, c in rows], dtype=float)

    same = F.col("__shape").eqNullSafe(shape) & F.col("__data").isNotNull()
    fraction = F.when(same, pandas_udf(run, "double")("data", F.when(same, F.col("__data")), "height", "width", "nChannels")).otherwise(1.0)
    marked = before.withColumn("fraction", fraction).drop("__data", "__shape")
    fresh = reset if reset is not None else F.lit(False)
    return marked.withColumn("changed", fresh | is_changed(F.col("fraction")))


def is_changed(fraction: Column) -> Column:
    return fraction >= FRAME_CHANGE
