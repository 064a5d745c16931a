import random
import time

import pytest

from tests.conftest import SF
from veilspark.functions import fuzzy
from veilspark.operators import personal
from veilspark.plans import catalog


def texts(seed, n):
    rng = random.Random(seed)
    words = ["john", "doe", "jonn", "dough", "apache", "licence", "license", "version", "the", "aaa", "a", "ab", "qu", "2.0", "zz"]
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        yield "".join(rng.choice("abjohn ") if rng.random() < 0.03 else c for c in t)


@pytest.mark.parametrize("threshold", [60.0, 85.0, 95.0])
@pytest.mark.parametrize("pattern", ["John Doe", "Apache Licence, Version 2.0", "aaaa", "ab", "aaa aaa aaaa", "x", " "])
def test_search_is_the_scorer_from_the_threshold_on(pattern, threshold):
    p = fuzzy.Pattern(pattern, threshold)
    for text in [*texts(3, 120), "", " ", pattern, pattern[1:], "x" + pattern[:-1], pattern.upper() + " more"]:
        want = fuzzy.score(pattern, text)
        assert p.score(text) == (want if want >= threshold else 0.0), text
        part = fuzzy.partial_ratio(pattern.lower(), text.lower())
        assert p.partial(text.lower()) == (part if part >= threshold else 0.0), text


def test_a_long_text_without_a_piece_costs_a_look():
    p = fuzzy.Pattern("Apache Licence, Version 2.0", 85.0)
    start = time.time()
    assert p.score("the quick brown fox jumps over a dog " * 30_000) == 0.0
    assert time.time() - start < 2


def test_documents_equal_the_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    wanted = ["Apache Licence, Version 2.0", "patethic"]
    got = {(r.doc_id, r.part): r.score for r in personal.approximate(docs, wanted, threshold=85.0).collect()}
    want = {}
    for r in docs.collect():
        line = " ".join((r.text or "").split())
        for k, s in enumerate(wanted):
            # short texts alone can score by anything but a stretch near the pattern
            if s[:4].lower() in line.lower() or len(line) < 200:
                score = fuzzy.score(s, line[:4000]) if len(line) < 4000 else fuzzy.Pattern(s, 85.0).score(line)
                if score >= 85:
                    want[r.doc_id, k] = score
    assert {k: v for k, v in got.items() if k in want} == want


def test_query_places_what_it_finds(spark):
    rows = catalog.personal_fuzzy_places(spark, SF).collect()
    assert all(r.w > 0 and r.h > 0 and r.confidence >= 0.85 for r in rows) and rows
