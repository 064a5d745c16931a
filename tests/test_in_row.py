"""What is found in a document is placed in its row: plans without joins and shuffles, and results against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veilspark.functions import sql
from veilspark.operators import api_keys, cards, crypto, layout, personal, seeds, spatial
from veilspark.plans import catalog
from veilspark.sources.patterns import BUILT_IN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fuzzy_places_search_a_document_once(spark):
    shown = plan(personal.detect(docs(spark, "x"), ["Apache Licence", "patethic"], fuzzy_match=True))
    # one pass over texts for all strings; the others score the tokens of what it found
    assert "Join" not in shown and "Union" not in shown


@pytest.mark.parametrize("detect", [cards.detect, crypto.detect])
def test_cards_and_wallets_shuffle_nothing(spark, detect):
    shown = plan(detect(docs(spark, "x")))
    assert "Join" not in shown and "Exchange" not in shown


def test_keys_and_strings_join_nothing(spark):
    assert "Join" not in plan(api_keys.detect(docs(spark, "x"))) and "Join" not in plan(personal.detect(docs(spark, "x"), ["x"]))


def test_lines_of_recovery_phrases_are_not_sorted(spark):
    words = spark.createDataFrame([("word",)], "word string")
    assert "SortAggregate" not in plan(seeds.detect(layout.tokens(docs(spark, "x")), words))


def test_overlapping_tokens_shuffle_nothing(spark):
    assert "Exchange" not in plan(spatial.overlapping_pairs(layout.tokens(docs(spark, "x")), "doc_id", "ord", gathered=True))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9, 1.0])
def test_pairs_by_brute_force(spark, threshold, monkeypatch):
    rng = random.Random(5)
    rows = [(k % 7, k, rng.randrange(-20, 60), rng.randrange(40), rng.choice((0, 3, 8, 20, 90)), rng.choice((0, 5, 20, 21))) for k in range(500)]
    boxes = spark.createDataFrame(rows, "k long, o long, x long, y long, w long, h long").coalesce(1)

    def iou(a, b):
        iw, ih = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        return iw > 0 and ih > 0 and iw * ih >= threshold * (a[4] * a[5] + b[4] * b[5] - iw * ih)

    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a, b))
    assert sorted(tuple(r) for r in spatial.overlapping_pairs(boxes, "k", "o", threshold).collect()) == want
    by_key = boxes.sortWithinPartitions("k")
    assert sorted(tuple(r) for r in spatial.overlapping_pairs(by_key, "k", "o", threshold, gathered=True).collect()) == want


def test_whole_keys_stand_together():
    import pyarrow as pa

    keys = [k for k in range(5) for _ in range(60_000)]
    batches = pa.table({"k": keys}).to_batches(max_chunksize=7000)
    cut = [t.column("k").to_pylist() for t in spatial._together(iter(batches))]
    assert sum(cut, []) == keys and len(cut) > 1 and all(a[-1] != b[0] for a, b in zip(cut, cut[1:], strict=False))


def test_findings_join_a_text_once():
    body = next(s for s in sql.statements() if "findings(given" in s)
    assert body.count(sql._LINE) == 1


def test_orders_are_dealt_to_all_cores_and_texts_made_once(spark):
    made = catalog._secrets(spark, SF)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # the filter on the text stands over the generator that makes it
    shown = plan(made.where("text rlike 'x'"))
    assert shown.index("RLIKE") < shown.index("Generate") and shown.count("md5") <= shown[shown.index("Generate") :].count("md5")


def test_texts_with_cards_are_found_by_their_long_tokens(spark):
    """What the prefilter lets through, against the pattern that it stands for, and no pattern of a whole token at every place."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(("1", "l", "O", "7", "a", "-", "1", "é", "😀", " " if k % 3 else "4", "\n" if k % 5 else "x")) for _ in range(rng.randrange(60))) for k in range(400)]
    texts += ["x" * 15 + "1" * 16, "1" * 15 + " 1", "1x" * 15, "1x" * 16, ""]
    old = cards.GROUPS + r"|(?<!\S)(?:[^\s0-9lIOo]*+[0-9lIOo]){16}"
    kept = docs(spark, *texts).select("text", cards._could("text").alias("could"), F.col("text").rlike(old).alias("old"))
    assert {(True, True), (False, False)} == {(r.could, r.old) for r in kept.collect()}
    assert "(?<!" not in plan(docs(spark, "x").where(cards._could("text"))) and "(?<!\\\\S)" not in sql.SCALARS["card_numbers"][1]


def test_fixed_texts_of_keys_are_in_their_patterns(spark):
    assert all(p.needs in p.pattern.replace("\\.", ".") for p in BUILT_IN) and sum(p.needs != "" for p in BUILT_IN) == 21
    assert "ontains" in plan(api_keys.first_matches(docs(spark, "x")))


def test_the_dictionary_is_one_plan_for_all_joins(spark):
    texts = docs(spark, "some words")
    shown = plan(seeds.detect(layout.tokens(texts), seeds.dictionary(texts)))
    assert len(re.findall(r"Filter isnotnull\(word#\d+\)\n[^\n]*TakeOrderedAndProject", shown)) == shown.count("TakeOrderedAndProject") == 3
