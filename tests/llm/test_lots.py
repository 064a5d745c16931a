from tests.llm.test_pairs import brute, near_copies
from veilspark.llm import ngram_join, set_groups
from veilspark.llm.stage import Scratch


def test_a_full_set_goes_once_to_its_lot(spark, tmp_path):
    """All 190 tests of a family of 20 texts: 20 sets are sent, not two with each test."""
    texts = [" ".join(f"w{i}" for i in range(59)) + f" own{k}" for k in range(20)]
    base = spark.createDataFrame(list(enumerate(texts)), "doc long, txt string")
    run, schema = set_groups._full_sets(5)
    fps = [r.fp for r in base.orderBy("doc").coalesce(1).select("txt").mapInArrow(run, schema).collect()]
    rows = [(a, b, fps[a], fps[b], a, b, 56, 56, 0) for a in range(20) for b in range(a)]
    tests = spark.createDataFrame(rows, "ca long, cb long, a binary, b binary, least_a long, least_b long, n_a long, n_b long, bucket long")
    dealt = set_groups._lots(tests)
    assert dealt.count() == 190 and dealt.select("lot").distinct().count() == 1
    sets = set_groups._full(dealt, base, 5, False, Scratch(spark, "t"))
    assert sorted(r.fp for r in sets.collect()) == sorted(fps)
    assert set_groups._lots(tests.where("false")) is None


def test_buckets_larger_than_a_lot(spark, monkeypatch):
    monkeypatch.setattr(set_groups, "LOT_BYTES", 2000)
    texts = dict(enumerate(near_copies(5, 30, edits=6)))
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(texts)[0]
