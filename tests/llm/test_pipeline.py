import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_pairs import brute
from veilspark.llm import decontaminate


def test_stages(spark):
    """Each stage keeps the contract on its own input, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch = docs.columns, corpus_pipeline.Scratch(spark, "t")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.save(stage(spark, docs, SF), name.replace(" ", "-"))
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert 0 < docs.count() <= before.count()
    before, after = seen["n-gram Jaccard join"]
    comp, _ = brute({r.doc_id: r.text for r in before.collect()})
    assert {r.doc_id for r in after.collect()} == {i for i, c in comp.items() if i == c}
    before, after = seen["benchmark decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [" ".join(r.text.split()) for r in items.collect()]
    for r in after.collect():
        assert not any(t in " ".join((r.text or "").split()) for t in texts)
    assert decontaminate.find_leaks(after, items).count() == 0
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    last = {r.doc_id: r for r in seen[corpus_pipeline.STAGES[-1][0]][1].collect()}
    into = {r.doc_id for r in seen[corpus_pipeline.STAGES[-1][0]][0].collect()}
    clean = {i for i in into if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
    assert clean <= set(last)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "rate", "copies"} <= set(out.columns) and out.count() > 0


def test_stages_take_anything(spark, tmp_path):
    """Nulls in every column, empty, blank and long texts, repeated rows, string ids, no labels, no items, an empty table."""
    rows = [
        ("a", None, None, None, None), ("b", "", "en", "s", 0), ("c", " \n ", "en", None, 3), (None, "text of a row without an id", "en", "s", 27), ("d", "same words in two rows here", "en", "s", 27),
        ("d", "same words in two rows here", "en", "s", 27), ("e", "same words in two rows here", None, "s", 27), ("f", "word " * 30_000, "en", "s", 150_000), ("g", "x" * 9000, "en", "s", 9000),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    labels = "doc_id string, quality int, toxic int"
    for k, (given, known, items) in enumerate(((docs, [], []), (docs, [("b", 1, 0), ("f", 0, 1), ("x", None, None), (None, 1, 1)], [(1, "same words in two rows here"), (2, None)]), (docs.where("false"), [], []))):
        d = str(tmp_path / str(k))
        given.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(known, labels).write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        before = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, d)
            assert after.columns == docs.columns, name
            assert after.count() <= before.count()
        out = corpus_pipeline.run(spark, d).collect()
        assert (len(out) > 0) == (k < 2)
        if k == 0:
            # equal texts leave one id of a group, with all its rows; a row without an id stays
            assert sorted(str(r.doc_id) for r in out) == ["None", "a", "b", "c", "d", "d", "f", "g"] and {r.rate for r in out} == {1.0}


def test_mixing_stage_by_brute_force(spark):
    """The last stage gives what mixing gives, but for the documents with rate 0."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()}
    every = {r.doc_id: r for r in corpus_pipeline.mixing.mix(docs, corpus_pipeline.domains_of(spark.read.parquet(f"{SF}/labels.parquet")), "domain", corpus_pipeline.MIX_WEIGHTS).collect()}
    assert out == {i: r for i, r in every.items() if r.rate > 0}
