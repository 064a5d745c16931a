import os

import corpus_pipeline
from tests.conftest import SF


def test_only_the_last_table_stays(spark, monkeypatch):
    """Tables of earlier stages do not add up beside the next stage's work."""
    beside = []

    def stage(spark, docs, sf_dir):
        beside.append([len(os.listdir(r)) for r in roots()])
        return docs.where("doc_id % 2 = 0")

    base = spark.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(base)) if os.path.isdir(base) else set()
    roots = lambda: [f"{base}/{x}" for x in (os.listdir(base) if os.path.isdir(base) else ()) if x.startswith("corpus-pipeline-") and x not in there]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage {k}", stage) for k in range(4)])
    out = corpus_pipeline.run(spark, SF)
    assert beside == [[], [1], [1], [1]] and [len(os.listdir(r)) for r in roots()] == [1]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0").count()
