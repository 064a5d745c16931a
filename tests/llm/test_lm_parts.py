import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.helpers import edge_cases, empty_docs
from veilspark.llm import lm_score


def scores(docs, training):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm_score.score_texts(docs, training).collect())


@pytest.mark.parametrize("ask", [8 << 20, 200_000])
def test_scores_do_not_depend_on_the_cap(spark, monkeypatch, ask):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    training = docs.where("doc_id % 3 <> 0")
    whole = scores(docs, training)
    monkeypatch.setattr(lm_score, "MAX_FILTER_BYTES", 1 << 10)
    monkeypatch.setattr(lm_score, "ASK_BYTES", ask)
    parts = scores(docs, training)
    assert [x[:3] for x in parts] == [x[:3] for x in whole]
    for a, b in zip(parts, whole, strict=True):
        assert a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_parts_edge_cases(spark, monkeypatch):
    cases = edge_cases(spark)
    whole = scores(cases, cases)
    monkeypatch.setattr(lm_score, "MAX_FILTER_BYTES", 0)
    parts = scores(cases.repartition(5), cases)
    assert [x[:3] for x in parts] == [x[:3] for x in whole]
    assert [x[4] for x in parts] == pytest.approx([x[4] for x in whole], rel=1e-9)
    inside = scores(cases, F.lit(True))
    assert [x[:3] for x in inside] == [x[:3] for x in whole] and [x[4] for x in inside] == pytest.approx([x[4] for x in whole], rel=1e-9)
    assert lm_score.score_texts(empty_docs(spark), cases).count() == 0
    assert lm_score.score_texts(empty_docs(spark), F.lit(True)).count() == 0
    assert {(r.n_known, r.train_tokens) for r in lm_score.score_texts(cases, F.lit(False)).collect()} == {(0, 0)}
