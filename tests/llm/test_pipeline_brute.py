"""The whole pipeline against plain Python on a table of 200 documents."""

import string
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_pairs import brute
from veilspark.llm import line_dedup, mixing, quality

AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BARE = str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)


def deduped(texts, least=10):
    """Texts without the lines that ``least`` documents have."""
    key = lambda line: line.strip(line_dedup.SPACE).translate(AZ)
    seen = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    return {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < least) for i, t in texts.items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def leaks(text, items):
    """Whether some window of an item's length is within a fifth of its words in edits."""
    body = text.translate(BARE).split()
    for item in items:
        n, most = len(item), len(item) // 5
        need, have = Counter(item), Counter(body[:n])
        common = sum((need & have).values())
        for s in range(len(body) - n + 1):
            if common >= n - most and distance(body[s : s + n], item) <= most:
                return True
            if s + n < len(body):
                out, new = body[s], body[s + n]
                common -= have[out] <= need[out]
                have[out] -= 1
                have[new] += 1
                common += have[new] <= need[new]
    return False


def test_run_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).collect() if r.score >= 0.3}
    texts = deduped({r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good})
    comp, _ = brute(texts)
    texts = {i: t for i, t in texts.items() if comp[i] == i}
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := (r.text or "").translate(BARE).split())]
    texts = {i: t for i, t in texts.items() if not leaks(t, items)}
    assert 0 < len(texts) < len(good) < docs.count()
    kept = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = {r.doc_id: r for r in mixing.mix(kept, corpus_pipeline.domains_of(labels), "domain", corpus_pipeline.MIX_WEIGHTS).where(F.col("rate") > 0).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for i, row in got.items():
        assert (row.n_tokens, row.posterior, row.copies) == (want[i].n_tokens, want[i].posterior, want[i].copies) and abs(row.rate - want[i].rate) < 1e-6
