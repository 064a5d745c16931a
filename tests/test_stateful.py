import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from veilspark.operators import frames, stateful, stats
from veilspark.sources import logs, patterns


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_gate(spark):
    f = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None), (2, 2, None)], "k long, t long, v string")
    got = {(r.k, r.t): r.changed for r in stateful.change_gate(f, "k", "t", "v").collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): True, (2, 2): False}


def test_holds_and_returns(spark):
    t = spark.createDataFrame([(1, at(0)), (1, at(3)), (1, at(10))], "k long, ts timestamp")
    h = stateful.holds(t, "k", "ts", "3 seconds")
    rows = sorted((r.hold_start, r.hold_end, r.n_triggers) for r in h.collect())
    assert rows == [(at(0), at(6), 2), (at(10), at(13), 1)]
    manual = spark.createDataFrame([(1, at(4)), (1, at(20))], "k long, ts timestamp")
    early = sorted((r.hold_start, r.hold_end, r.early) for r in stateful.early_return(h, manual, "k", "ts").collect())
    assert early == [(at(0), at(4), True), (at(10), at(13), False)]
    scenes = spark.createDataFrame([(1, at(-5), "desk"), (1, at(8), "game")], "k long, ts timestamp, scene string")
    back = sorted((r.hold_start, r.return_scene) for r in stateful.scene_before(scenes, h, "k", "ts", "scene").collect())
    assert back == [(at(0), "desk"), (at(10), "game")]


def test_pause(spark):
    e = spark.createDataFrame([(1, i, at(i), k) for i, k in enumerate(["x", "pause", "x", "resume", "x"])], "k long, i long, ts timestamp, kind string")
    left = stateful.without_pauses(e, "k", "ts", "i", F.col("kind") == "pause", F.col("kind") == "resume")
    assert sorted(r.i for r in left.collect()) == [0, 4]


def test_percentiles(spark):
    v = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "k string, v double")
    low = stats.percentiles(v, "k", "v", {"p50": 0.5, "p95": 0.95}, before=True).first()
    high = stats.percentiles(v, "k", "v", {"p50": 0.5, "p95": 0.95}, before=False).first()
    assert (low.p50, low.p95, high.p50, high.p95) == (10.0, 19.0, 11.0, 20.0)


def test_log(spark):
    lines = spark.createDataFrame([('{"type":"a","action":"blur"}',), ("{bad",), ('{"action":"warn"}',)], "value string")
    counts = {(r.dimension, r.name): r.n for r in stats.log_counts(logs.parse(lines)).collect()}
    assert counts == {("type", "a"): 1, ("type", "unknown"): 1, ("action", "blur"): 1, ("action", "warn"): 1, ("total", "all"): 2}


def test_catalog(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text('{"_note": "x", "S": [{"pattern": "a+"}]}')
    assert patterns.read_json(spark, str(p)) == (patterns.KeyPattern("S", "a+", "S", 0.90),)
    assert patterns.read_json(spark, str(tmp_path / "none.json")) == ()
    assert len({x.service for x in patterns.BUILT_IN}) == 14 and len(patterns.BUILT_IN) == 25


def test_pixels():
    a = np.full((48, 64, 3), 100, np.uint8)
    assert (frames.invert_if_dark(a) == 155).all()
    assert (frames.invert_if_dark(np.full((2, 2, 3), 127, np.uint8)) == 127).all()
    g = frames.gray(a)
    assert frames.change_fraction(g, g) == 0
    one = a.copy()
    one[5, 5] = 255
    assert frames.change_fraction(g, frames.gray(one)) < frames.FRAME_CHANGE
    block = a.copy()
    block[10:30, 10:40] = 255
    assert frames.change_fraction(g, frames.gray(block)) >= frames.FRAME_CHANGE
    (box,) = frames.changed_regions(frames.change_mask(g, frames.gray(block)))
    assert abs(box[0] - 10) <= 2 and abs(box[2] - 30) <= 4
