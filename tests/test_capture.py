import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import frames
from veilspark.sources import capture


def png(rows):
    """Bytes of an RGB image."""
    height, width, _ = rows.shape
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture()
def folder(tmp_path):
    plain = np.full((40, 60, 3), 90, np.uint8)
    spot, two = plain.copy(), plain.copy()
    spot[5:20, 10:30] = 250
    two[5:20, 10:30], two[22:38, 40:56] = 250, 250
    (tmp_path / "images").mkdir()
    for k, image in enumerate((plain, spot, two)):
        (tmp_path / "images" / f"{k}.png").write_bytes(png(image))
    return str(tmp_path / "images")


def test_frames_cycle_in_order(spark, folder):
    got = capture.frames(spark, "files", folder, 7).orderBy("tick").collect()
    assert [r.origin[-5] for r in got] == list("0120120") and len(capture.frames(spark, "files", folder).collect()) == 3
    with pytest.raises(ValueError):
        capture.frames(spark, "screen")
    with pytest.raises(ValueError):
        capture.frames(spark, "camera", folder)


def test_no_image_is_an_error(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.png").write_bytes(b"no image")
    with pytest.raises(FileNotFoundError):
        capture.frames(spark, "files", str(tmp_path / "none"))


def test_stream_cycles_and_is_gated(spark, folder, tmp_path):
    """Frames of a stream, batch by batch, equal those of the table, and so do the changes between them."""
    stream = capture.stream(spark, "files", folder, per_batch=2)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    started = time.time()
    schema = stream.schema
    while time.time() - started < 60:
        if query.lastProgress and query.lastProgress["batchId"] >= 4:
            break
        time.sleep(0.2)
    query.stop()
    got = spark.read.schema(schema).parquet(str(tmp_path / "out")).where("tick < 8")
    want = capture.frames(spark, "files", folder, 8)
    keep = lambda df: sorted((r.tick, r.origin, bytes(r.data)) for r in df.collect())
    assert keep(got) == keep(want)
    gate = lambda df: [r.changed for r in frames.gate_frames(df.withColumn("s", F.lit(1)), "s", "tick").orderBy("tick").collect()]
    assert gate(got) == gate(want) == [True] * 8


def test_regions_of_image_files(spark, folder):
    images = capture.frames(spark, "files", folder, 4).withColumn("s", F.lit("s"))
    got = [r.regions for r in frames.region_frames(images, "s", "tick").orderBy("tick").collect()]
    near = lambda box, want: all(abs(a - b) <= 4 for a, b in zip(box, want, strict=True))
    assert got[0] is None and len(got[1]) == 1 and near(got[1][0], (10, 5, 20, 15))
    assert len(got[2]) == 1 and near(got[2][0], (40, 22, 16, 16)) and len(got[3]) == 2


def flooded(mask):
    """Boxes by walking from pixel to pixel."""
    left, out = {(int(y), int(x)) for y, x in np.argwhere(mask)}, []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        if len(seen) >= max(100, mask.size // 10_000):
            ys, xs = zip(*seen, strict=True)
            out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return sorted(out, key=lambda b: (b[1], b[0]))


def test_regions_equal_a_walk_over_pixels():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.3, 0.38, 0.45, 0.7):
        mask = rng.random((70, 90)) < share
        assert frames.changed_regions(mask) == flooded(mask)
    assert frames.changed_regions(np.zeros((30, 30), bool)) == []
    assert frames.changed_regions(np.ones((30, 40), bool)) == [(0, 0, 40, 30)]


def test_a_long_path_takes_no_longer_than_its_stretches():
    mask = np.zeros((1000, 1000), bool)
    mask[::2] = True
    mask[1::4, -1], mask[3::4, 0] = True, True
    start = time.time()
    assert frames.changed_regions(mask) == [(0, 0, 1000, 999 + bool(mask[-1].any()))] and time.time() - start < 5
