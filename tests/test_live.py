import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import live, stateful
from veilspark.streaming import live as streaming
from veilspark.streaming import scans

SCHEMA = "k long, ts timestamp, kind int, scene string"
T, R, S = live.TRIGGER, live.RETURN, live.SCENE


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def simulated(rows, hold, auto=True, privacy=None):
    """A client that takes the marks one by one: (key, start, end, triggers, early, scene), with holds still open."""
    out = []
    for key in {r[0] for r in rows}:
        start = last = back = remembered = None
        n = 0
        for _, t, kind, scene in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3] or "")):
            if start is not None and auto and (t > last + hold or (t == last + hold and kind != T)):
                out.append((key, start, last + hold, n, False, back))
                start = None
            if kind == T:
                if start is None:
                    start, back, n = t, remembered, 0
                last, n = t, n + 1
            elif kind == R and start is not None:
                out.append((key, start, t, n, True, back))
                start = None
            elif kind == S and start is None and scene != privacy:
                remembered = scene
        if start is not None:
            out.append((key, start, last + hold if auto else None, n, False, back))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(k, at(t), kind, scene) for k, t, kind, scene in rows], SCHEMA)


def in_seconds(rows):
    sec = lambda v: None if v is None else (v - at(0)).total_seconds()
    return sorted(((r.k, sec(r.hold_start), sec(r.hold_end), r.n_triggers, r.early, r.return_scene) for r in rows), key=str)


def random_rows(seed, n=300, span=400):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.randrange(span), kind := rng.choice([T, T, R, S, S]), rng.choice("abp") if kind == S else None) for _ in range(n)]


def test_a_hold_opens_restarts_and_returns(spark):
    rows = [(1, 0, S, "desk"), (1, 1, T, None), (1, 4, T, None), (1, 5, S, "game"), (1, 9, S, "film"), (1, 10, T, None), (1, 11, R, None), (1, 12, T, None), (1, 30, R, None)]
    got = in_seconds(live.holds(table(spark, rows), "k", "ts", "3 seconds").collect())
    # a trigger at the very end goes on; scenes inside a hold are not remembered, those after it are
    assert got == [(1, 1, 7, 2, False, "desk"), (1, 10, 11, 1, True, "film"), (1, 12, 15, 1, False, "film")]


@pytest.mark.parametrize(("auto", "privacy"), [(True, None), (True, "p"), (False, "p")])
def test_holds_equal_a_client(spark, auto, privacy):
    rows = random_rows(1) + random_rows(2, 60, 5000)
    got = in_seconds(live.holds(table(spark, rows), "k", "ts", "7 seconds", auto_return=auto, privacy=privacy).collect())
    assert got == simulated(rows, 7, auto, privacy)


def test_without_returns_they_are_session_windows(spark):
    rows = [r for r in random_rows(4) if r[2] == T]
    frame = table(spark, rows)
    own = {(r.k, r.hold_start, r.hold_end, r.n_triggers) for r in live.holds(frame, "k", "ts", "5 seconds").collect()}
    assert own == {tuple(r) for r in stateful.holds(frame, "k", "ts", "5 seconds").collect()}


def test_null_keys_times_and_empty_tables(spark):
    rows = [(None, at(1), T, None), (None, at(2), T, None), (1, None, T, None)]
    got = live.holds(spark.createDataFrame(rows, SCHEMA), "k", "ts", "3 seconds").collect()
    assert [(r.k, r.n_triggers) for r in got] == [(None, 2)]
    assert live.holds(spark.createDataFrame([], SCHEMA), "k", "ts", "3 seconds").count() == 0
    events = spark.createDataFrame([(1, at(1), "x"), (1, None, "x"), (1, at(2), None)], "k long, ts timestamp, e string")
    assert live.marks(events, "k", "ts", F.col("e") == "t", F.col("e") == "r", F.col("e")).count() == 1


@pytest.mark.parametrize(("auto", "files"), [(True, 1), (True, 3), (False, 1)])
def test_stream_equals_a_client(spark, tmp_path, auto, files):
    """Marks out of order within the watermark's delay, in several micro-batches, two rows at a time for Python."""
    rows = random_rows(6, 240, 600)
    rng = random.Random(8)
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 15))
    for a in range(0, len(rows), 40):
        table(spark, rows[a : a + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
        out = streaming.holds(stream, "k", "ts", "7 seconds", late="20 seconds", auto_return=auto)
        got = in_seconds(scans.to_table(out, str(tmp_path / "out"), str(tmp_path / "state")).collect())
    finally:
        spark.conf.set(name, before)
    over = max(r[1] for r in rows) - 20
    assert got == [h for h in simulated(rows, 7, auto) if h[2] is not None and h[2] <= over]


def test_marks_that_come_too_late_are_dropped(spark, tmp_path):
    # Spark drops what the watermark of the batch before had passed
    parts = [[(1, 0, T, None)], [(1, 100, S, "x")], [(1, 101, S, "x")], [(1, 5, T, None)], [(1, 300, S, "x")]]
    for part in parts:
        table(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = scans.to_table(streaming.holds(stream, "k", "ts", "7 seconds", late="10 seconds"), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert in_seconds(got) == [(1, 0, 7, 1, False, None)]
