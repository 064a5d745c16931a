import random

from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.operators import cards, places
from veilspark.operators.layout import CHAR, LINE


def test_tokens_around_a_point_by_brute_force():
    """On plain numbers of many documents, one after the other, as a batch has them."""
    rng = random.Random(4)
    line, middle, bounds = [], [], [0]
    for _ in range(40):
        for n in sorted(rng.sample(range(30), rng.randrange(8))):
            centres = sorted(rng.sample(range(0, 60 * CHAR), rng.randrange(1, 9)))
            line += [n] * len(centres)
            middle += centres
        bounds.append(len(line))
    for a, b in zip(bounds, bounds[1:], strict=False):
        for radius in (1, 30, 100, 250):
            x, y = rng.randrange(60 * CHAR), rng.randrange(30 * LINE)
            want = [i for i in range(a, b) if (middle[i] - x) ** 2 + (line[i] * LINE + LINE // 2 - y) ** 2 <= radius * radius]
            assert places._around(x, y, radius, line, middle, a, b) == want


def test_checksum_of_a_card_is_one_call(spark):
    rng = random.Random(6)
    numbers = [f"{rng.randrange(10**16):016d}" for _ in range(300)] + ["0" * 16, "4111111111111111", "4111111111111112"]
    df = spark.createDataFrame([(n,) for n in numbers], "number string").select(cards._luhn(F.col("number")).alias("got"), X.luhn_ok(F.col("number")).alias("want"))
    rows = df.collect()
    assert all(r.got == r.want for r in rows) and {r.got for r in rows} == {True, False}
    assert df.select("got")._jdf.queryExecution().optimizedPlan().toString().count("substring") == 0
