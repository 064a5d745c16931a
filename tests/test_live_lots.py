import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import live
from veilspark.streaming import live as streaming
from veilspark.streaming import scans

SCHEMA = "k long, ts timestamp, kind int, scene string"
#: Neighbours that a double cannot tell apart.
BIG = 2**60


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def rows_of(rows):
    return sorted((str(tuple(r)) for r in rows.collect()))


def test_python_is_called_for_lots_of_keys(spark, tmp_path):
    """The state has a row for a lot; a call of Python takes longer than the marks of many keys."""
    n = 3000
    marks = spark.range(n * 4).selectExpr("id % 3000 AS k", "timestamp_seconds(1704067200 + id) AS ts", "CAST(id % 7 % 3 AS INT) AS kind", "IF(id % 7 % 3 = 2, 'desk', NULL) AS scene").coalesce(1)
    marks.write.parquet(str(tmp_path / "in"))
    out = streaming.holds(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", "ts", "50 seconds")
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1025
    over = 1704067200 + n * 4 - 1 - 10
    want = live.holds(spark.read.parquet(str(tmp_path / "in")), "k", "ts", "50 seconds").where(F.unix_seconds("hold_end") <= over)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(want)


@pytest.mark.parametrize("kind", ["k", "CAST(k AS STRING)", "CAST(k AS DECIMAL(20,0))", f"DATE_ADD(DATE'2024-01-01', CAST(k - {BIG} AS INT))", f"IF(k = {BIG}, DOUBLE('NaN'), DOUBLE(k - {BIG}))"])
def test_keys_of_a_lot_are_kept_apart(spark, tmp_path, kind):
    """Long, text, decimal, day and NaN as keys, and rows without one, in several micro-batches that share two lots."""
    rng = random.Random(3)
    rows = [(rng.choice([None, BIG, BIG + 1, BIG + 2, BIG + 3]), at(t), c := rng.choice([0, 0, 1, 2, 2]), rng.choice("ab") if c == 2 else None) for t in range(0, 400, 2)]
    marks = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.expr(kind))
    for a in range(0, 400, 100):
        part = marks.where((F.col("ts") >= F.lit(at(a))) & (F.col("ts") < F.lit(at(a + 100))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = scans.to_table(streaming.holds(stream, "k", "ts", "7 seconds", lots=2), str(tmp_path / "out"), str(tmp_path / "state"))
    want = live.holds(marks, "k", "ts", "7 seconds").where(F.col("hold_end") <= F.lit(at(398 - 10)))
    assert len(rows_of(want)) > 40 and rows_of(got) == rows_of(want)
