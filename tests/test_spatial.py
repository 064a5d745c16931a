import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import geometry as G
from veilspark.operators import cards, layout, pipeline, spatial


def boxes(seed, n, docs=3, span=300, most=60):
    rng = random.Random(seed)
    one = lambda: (rng.randrange(-50, span), rng.randrange(span), rng.randrange(most), rng.randrange(1, most))
    rows = []
    for k in range(n):
        box = one() if not rows or rng.random() < 0.5 else tuple(v + rng.randrange(-3, 4) for v in rng.choice(rows)[2:6])
        rows.append((rng.choice([*range(docs), None]), k, *box))
    return rows


def iou(a, b, t):
    iw, ih = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return iw > 0 and ih > 0 and iw * ih >= t * (a[2] * a[3] + b[2] * b[3] - iw * ih)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_pairs_equal_all_pairs(spark, threshold):
    rows = boxes(1, 250)
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] is not None and a[1] < b[1] and min(a[4], a[5], b[4], b[5]) > 0 and iou(a[2:], b[2:], threshold)}
    frame = spark.createDataFrame(rows, "doc long, k long, x long, y long, w long, h long")
    got = [(r.doc, r.a, r.b) for r in spatial.overlapping_pairs(frame, "doc", "k", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        spatial.overlapping_pairs(frame, "doc", "k", 0)


def test_pairs_are_not_joined_by_document_alone(spark):
    frame = spark.createDataFrame([(1, k, 40 * k, 0, 30, 20) for k in range(2000)], "doc long, k long, x long, y long, w long, h long")
    pairs = spatial.overlapping_pairs(frame, "doc", "k")
    assert pairs.count() == 0 and spatial.overlapping_pairs(frame.limit(0), "doc", "k").count() == 0
    assert "doc#" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and "__uc" in plan and "Cartesian" not in plan


def loop(rows, t=0.5):
    """Leaders one by one."""
    leaders, best = [], {}
    for r in rows:
        at = next((k for k, g in enumerate(leaders) if min(g[4], g[5], r[4], r[5]) > 0 and iou(g[2:6], r[2:6], t)), None)
        if at is None:
            leaders.append(r)
            best[len(leaders) - 1] = r
        elif r[6] > best[at][6]:
            best[at] = r
    return {b[1] for b in best.values()}


def test_merge_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(*r, rng.choice([0.6, 0.8, 0.9])) for r in boxes(2, 400)]
    frame = spark.createDataFrame(rows, "doc long, det_ord long, x long, y long, w long, h long, confidence double")
    got = {(r.doc, r.det_ord) for r in pipeline.merge_overlaps(frame, "doc").collect()}
    assert got == {(d, k) for d in {r[0] for r in rows} for k in loop([r for r in rows if r[0] == d])}


def test_merge_of_ten_thousand_boxes_in_a_document(spark):
    rows = [(1, *r[1:], 0.5 + (r[1] * 7919 % 100) / 250) for r in boxes(3, 10_000, span=6000)]
    frame = spark.createDataFrame(rows, "doc_id long, det_ord long, x long, y long, w long, h long, confidence double").withColumn("metadata", F.create_map(F.lit("k"), F.col("det_ord").cast("string")))
    start = time.time()
    got = pipeline.merge_overlaps(frame).collect()
    assert time.time() - start < 60
    assert {r.det_ord for r in got} == loop(rows) and all(r.metadata == {"k": str(r.det_ord)} for r in got)


def test_within_equals_all_pairs(spark):
    a = spark.createDataFrame(boxes(5, 80), "doc long, k long, x long, y long, w long, h long")
    b = spark.createDataFrame(boxes(6, 80), "doc long, j long, tx long, ty long, tw long, th long")
    got = {(r.doc, r.k, r.j) for r in spatial.within(a, b, "doc", 100).collect()}
    every = a.join(b, "doc").where(G.distance(G.box(), G.box("t")) <= 100)
    assert got == {(r.doc, r.k, r.j) for r in every.collect()} and got


def test_cards_of_a_document_full_of_numbers(spark, monkeypatch):
    rng = random.Random(7)

    def card():
        body = [rng.randrange(10) for _ in range(15)]
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(body))
        return "".join(map(str, [*body, -total % 10]))

    numbers = [card() for _ in range(600)]
    text = "\n\n\n\n\n\n\n\n".join(f"{n} Exp 12/27" if k % 2 else n for k, n in enumerate(numbers))
    texts = [(1, text), (2, f"{numbers[0]} Exp 12/27 CVV 123"), (3, f"{numbers[1]} x\n\n\n\n\n\n\n\n\n12/27")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(str, cards.detect(docs).collect()))
    assert len(got) == 602
    monkeypatch.setattr(spatial, "within", lambda a, b, key, radius: a.join(b, key).where(G.distance(G.box(), G.box("t")) <= radius))
    assert got == sorted(map(str, cards.detect(docs).collect()))


def test_layout_does_not_shuffle_and_long_lines_are_linear(spark):
    docs = spark.createDataFrame([(1, "ab  c\td\n\n e"), (2, None), (3, " \n "), (4, "word " * 50_000)], "doc_id long, text string")
    toks = layout.tokens(docs)
    assert "Exchange" not in toks._jdf.queryExecution().executedPlan().toString()
    got = [(r.ord, r.line_no, r.text, r.x, r.y, r.w) for r in toks.where("doc_id = 1").orderBy("ord").collect()]
    assert got == [(0, 0, "ab", 0, 0, 16), (1, 0, "c", 24, 0, 8), (2, 0, "d", 40, 0, 8), (3, 2, "e", 0, 40, 8)]
    last = toks.where("doc_id = 4").orderBy(F.desc("ord")).first()
    assert (last.ord, last.x) == (49_999, 5 * 49_999 * 8) and {r.doc_id for r in toks.select("doc_id").distinct().collect()} == {1, 4}
