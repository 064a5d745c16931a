"""Live holds on a stream: state of lots of keys with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.live import RETURN, SCENE, TRIGGER


@dataclass
class Hold:
    """The open hold of a key, and the scene to return to."""

    start: int | None = None
    last: int | None = None
    n_triggers: int = 0
    back: str | None = None
    remembered: str | None = None

    def close(self, at: int, early: bool) -> tuple:
        row = (self.start, at, self.n_triggers, early, self.back)
        self.start, self.last, self.n_triggers, self.back = None, None, 0, None
        return row

    def see(self, at: int, kind: int, scene: str | None, span: int | None, privacy: str | None) -> Iterator[tuple]:
        """Takes the next mark in order of time; yields the hold that it ends or finds ended."""
        if self.start is not None and span is not None and (at > self.last + span or (at == self.last + span and kind != TRIGGER)):
            yield self.close(self.last + span, False)
        if kind == TRIGGER:
            if self.start is None:
                self.start, self.back = at, self.remembered
            self.last, self.n_triggers = at, self.n_triggers + 1
        elif kind == RETURN and self.start is not None:
            yield self.close(at, True)
        elif kind == SCENE and self.start is None and scene != privacy:
            self.remembered = scene


#: Of a lot of keys, as Arrow: the holds and remembered scenes, and the marks that the watermark has not passed.
_STATE = "kept binary, waiting binary"
_KEPT = {"key": "object", "start": "int64", "last": "int64", "n_triggers": "int64", "back": "object", "remembered": "object"}
_MARKS = {"key": "object", "us": "int64", "kind": "int32", "scene": "object"}
#: The lot of the marks without a key.
_NO_KEY = -1


def _packed(rows: pd.DataFrame) -> bytes | None:
    if rows.empty:
        return None
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(given: bytes | None, types: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(columns=list(types)).astype(types) if given is None else pa.ipc.open_stream(pa.py_buffer(bytes(given))).read_pandas()


def _joined(parts: list) -> pd.DataFrame | pd.Series:
    """Parts one after another; those without rows would change the types."""
    return pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)


def _texts(column: pd.Series) -> list[str | None]:
    return [None if n else s for s, n in zip(column, column.isna(), strict=True)]


def _step(span: int | None, privacy: str | None):
    def run(lot: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (None, None)
        kept, waiting = _unpacked(old[0], _KEPT), _unpacked(old[1], _MARKS)
        fresh = [] if state.hasTimedOut else [pdf[list(_MARKS)] for pdf in batches]
        marks, passed = _joined([waiting, *fresh]), state.getCurrentWatermarkMs() * 1000
        ready, waiting = marks[marks["us"] <= passed], marks[marks["us"] > passed]
        # keys by number, those that are kept first; NaN is a key too
        numbers, keys = pd.factorize(_joined([kept["key"], ready["key"]]), use_na_sentinel=False)
        held = zip(kept["start"].tolist(), kept["last"].tolist(), kept["n_triggers"].tolist(), _texts(kept["back"]), _texts(kept["remembered"]), strict=True)
        every = [Hold(*h) if h[2] else Hold(remembered=h[4]) for h in held]
        every += [Hold() for _ in range(len(keys) - len(every))]
        number, scene = numbers[len(kept) :], np.array([*_texts(ready["scene"]), None], dtype="object")[:-1]
        order = np.lexsort((pd.factorize(pd.Series(scene).fillna(""), sort=True)[0], ready["kind"], ready["us"], number))
        taken = zip(*(np.asarray(c)[order].tolist() for c in (number, ready["us"], ready["kind"], scene)), strict=True)
        ended = [(k, *row) for k, *mark in taken for row in every[k].see(*mark, span, privacy)]
        timers = [int(waiting["us"].min())] if len(waiting) else []
        for k, hold in enumerate(every):
            due = None if hold.start is None or span is None else hold.last + span
            if due is not None and due <= passed:
                ended.append((k, *hold.close(due, False)))
            elif due is not None:
                timers.append(due)
        known = [k for k, h in enumerate(every) if h.start is not None or h.remembered is not None]
        # one that is not open has no triggers
        held = [(h.start or 0, h.last or 0, h.n_triggers, h.back, h.remembered) for h in (every[k] for k in known)]
        kept = pd.DataFrame(held, columns=list(_KEPT)[1:])
        kept.insert(0, "key", keys[np.array(known, dtype="int64")])
        state.update((_packed(kept), _packed(waiting)))
        if timers:
            # a timer runs when the watermark is over it: a millisecond before what it waits for
            state.setTimeoutTimestamp(max(-(-min(timers) // 1000) - 1, 1))
        if ended:
            out = pd.DataFrame(ended, columns=["key", "start", "end", "n_triggers", "early", "back"])
            out["key"], out["no_key"] = keys[out["key"].to_numpy()], lot[0] == _NO_KEY
            yield out

    return run


def holds(marks: DataFrame, key: str, ts: str, hold: str, *, late: str = "10 seconds", auto_return: bool = True, privacy: str | None = None, lots: int = 1024) -> DataFrame:
    """As ``operators.live.holds`` over a stream of marks, in append mode.

    A hold is put out once the watermark (``late`` behind the newest mark) has
    reached its end; open ones stay in the state. Marks wait in the state until
    the watermark has passed them, so that those out of order are taken in
    order, however they are cut into batches; marks that come later than that
    are dropped. Marks with a null key are a stream of their own.

    The state is that of ``lots`` lots of keys, so that Python is called once for
    a lot and not for each key, which takes longer than all its marks. A lot's
    state is read and written whole when one of its keys has a mark or a timer;
    streams of many small batches may want more lots. The number cannot change
    between runs of a checkpoint. Keys are of an atomic type.
    """
    spark = marks.sparkSession
    span = None
    if auto_return:
        span = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {hold}"))).first()[0]
    kind = marks.schema[key]
    out = T.StructType([T.StructField("key", kind.dataType), *T.StructType.fromDDL("start long, end long, n_triggers long, early boolean, back string, no_key boolean").fields])
    time = F.col(ts).cast("timestamp")
    # a null among long keys would make them doubles in pandas, and NaN comes back as null
    some = F.coalesce(key, F.lit("1970" if isinstance(kind.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "0").cast(kind.dataType))
    lot = F.when(F.col(key).isNull(), _NO_KEY).otherwise(F.pmod(F.hash(key), F.lit(lots)))
    timed = marks.where(F.col(ts).isNotNull()).select(lot.alias("lot"), some.alias("key"), time.alias("at"), F.unix_micros(time).alias("us"), "kind", "scene").withWatermark("at", late)
    ended = timed.groupBy("lot").applyInPandasWithState(_step(span, privacy), out, T.StructType.fromDDL(_STATE), "append", GroupStateTimeout.EventTimeTimeout)
    own = F.coalesce("key", F.lit(float("nan")).cast(kind.dataType)) if isinstance(kind.dataType, T.FractionalType) and not isinstance(kind.dataType, T.DecimalType) else F.col("key")
    moment = lambda c: F.timestamp_micros(c).cast(marks.schema[ts].dataType)
    return ended.select(F.when(~F.col("no_key"), own).alias(key), moment("start").alias("hold_start"), moment("end").alias("hold_end"), "n_triggers", "early", F.col("back").alias("return_scene"))
