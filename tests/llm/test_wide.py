import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_pairs import brute
from veilspark.llm import ngram_join, set_groups


def test_large_sets_that_only_share_a_key_are_not_sent(spark, monkeypatch):
    """Nine large texts in one group, of which two link: the others fill the small bitmaps, and their full sets stay."""
    rng = random.Random(3)
    texts = {k: [f"w{rng.randrange(10**6)}" for _ in range(8000)] for k in range(8)}
    texts[8] = [*texts[3][:7900], *(f"e{k}" for k in range(90 * 2))]
    texts = {k: " ".join(t) for k, t in texts.items()}

    def every(classes, scratch):
        least = classes.agg(F.min("cls")).first()[0]
        return scratch.save(classes.select(F.lit(1).cast("long").alias("key"), "cls", F.lit(least).alias("least"), F.lit(9).cast("long").alias("members")), "candidates")

    monkeypatch.setattr(set_groups, "_candidates", every)
    seen, lots = [], set_groups._lots
    monkeypatch.setattr(set_groups, "_lots", lambda tests: (seen.append(tests.count()), lots(tests))[1])
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(texts)[0]
    assert sum(seen) <= len(seen) and max(seen) == 1


def test_wide_bitmaps_lose_no_overlap():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(set_groups.LARGE + 1, 9000, 2))
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = (rng.choice(pool, k, replace=False) for k in (min(n, len(pool)), min(m, len(pool))))
        common = len(np.intersect1d(a, b))
        assert common <= set_groups._most_common(set_groups.wide_bitmap(a), len(a), set_groups.wide_bitmap(b), len(b)) <= min(len(a), len(b))
    assert set_groups.wide_bitmap(pool[: set_groups.LARGE]) is None


def test_a_repeated_shingle_stands_out_in_full_cells():
    """200 occurrences in a cell that has 1,600 by chance are five times what chance adds."""
    counts = np.full(ngram_join.CELL_BLOCK, 1600, np.uint32)
    counts[7] += 200
    out = ngram_join._add_counts(pa.table({"block": pa.array([0], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())}))
    level = np.frombuffer(out.column("levels")[0].as_py(), np.uint16)
    assert len(level) == ngram_join.CELL_BLOCK and level[7] > level[8]
