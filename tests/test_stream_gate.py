import random

from pyspark.sql import functions as F

from veilspark.operators import stateful
from veilspark.streaming import scans


def test_gate_does_not_depend_on_batch_cuts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 3 and 1, k, None if rng.random() < 0.1 else rng.choice("ab")) for k in range(120)]
    for part in (rows[:70], rows[70:]):
        rng.shuffle(part)
        spark.createDataFrame(part, "k long, t long, v string").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r.k, r.t): r.changed for r in stateful.change_gate(spark.createDataFrame(rows, "k long, t long, v string"), "k", "t", "v").collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        for files in (1, 10):
            stream = spark.readStream.schema("k long, t long, v string").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
            out = scans.change_gate_table(stream, "k", "t", "v", str(tmp_path / f"out{files}"), str(tmp_path / f"state{files}"))
            assert out.where(F.col("changed").isNull()).count() == 0
            assert {(r.k, r.t): r.changed for r in out.collect()} == want
    finally:
        spark.conf.set(key, before)
