import random

import numpy as np
import pytest

from tests.llm.helpers import components, edge_cases, empty_docs, shingles
from tests.llm.test_pairs import near_copies
from veilspark.llm import circulant, ngram_join, queries, set_groups


def brute(rows, width=2, percent=80):
    """Component of each (row number): the smallest id reachable; rows with one id are rows of their own."""
    sets = {k: shingles(t, width) for k, (_, t) in enumerate(rows)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    least = {}
    for k, c in comp.items():
        i = rows[k][0]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [(rows[k][0], len(sets[k]), least.get(comp[k])) for k in sets]


def chain(n, words=40):
    """Each text shares a little less than the threshold with the one after the next."""
    rng = random.Random(9)
    pool = [f"c{k}" for k in range(words + 3 * n)]
    return [" ".join(pool[2 * k : 2 * k + words]) for k in range(n)] + [" ".join(rng.sample(pool, 30)) for _ in range(5)]


def test_equals_brute_force(spark):
    texts = near_copies(1, 60) + near_copies(2, 40, edits=8) + chain(20) + [f"only {i} of its kind here" for i in range(30)] + ["a b", "a b", "a", "A", "", " ", None]
    rows = list(enumerate(texts))
    got = circulant.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


@pytest.mark.parametrize(("rounds", "block", "small"), [(0, 7, 8), (2, 7, 2), (0, 1000, 2), (1, 20, 8)])
@pytest.mark.parametrize("join", [circulant.near_duplicates, ngram_join.jaccard_components])
def test_big_groups_in_blocks(spark, monkeypatch, join, rounds, block, small):
    monkeypatch.setattr(set_groups, "ROUNDS", rounds)
    monkeypatch.setattr(set_groups, "BLOCK", block)
    monkeypatch.setattr(set_groups, "SMALL", small)
    monkeypatch.setattr(set_groups, "TESTS_PER_SET", 3)
    monkeypatch.setattr(set_groups, "SENT_SETS", 2)
    monkeypatch.setattr(set_groups, "SENT_IDS", 1)
    rows = list(enumerate(near_copies(5, 45, edits=6) + chain(12)))
    got = join(spark.createDataFrame(rows, "doc_id long, text string"), width=3).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, _, c in brute(rows, 3)}


def test_edge_cases_and_clashing_names(spark):
    docs = edge_cases(spark, *near_copies(3, 6))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in circulant.near_duplicates(docs).collect()), key=str)
    want = [(i, n, c if n else i) for i, n, c in brute(rows)]
    assert got == sorted(want, key=str)
    assert circulant.near_duplicates(empty_docs(spark)).count() == 0


def test_ids_of_other_types(spark):
    rows = [(f"{k:03d}", t) for k, t in enumerate(near_copies(7, 20, edits=3))]
    got = circulant.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, _, c in brute(rows)}


def test_an_id_with_many_rows(spark):
    rows = [(1, "one two three four")] * 30 + [(1, "quite another text here")] * 2 + [(2, "one two three four")]
    got = circulant.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1)] * 32 + [(2, 1)]


def test_signatures_are_shifted_permutations():
    """Coordinate k is the least place of the set under one permutation, shifted by k; no two shingles share a place."""
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    at = circulant.places(hashes)
    x = at + np.uint32(7)
    circulant._permute(x, np.empty_like(x), 0x7FEB352D, 0x846CA68B)
    assert circulant.signatures(hashes, np.array([0, len(hashes)]), 8)[7, 0] == x.min()
    every = np.arange(1 << 20, dtype=np.uint32)
    circulant._permute(every, np.empty_like(every), 0x21F0AAAD, 0x735A2D97)
    assert len(np.unique(every)) == 1 << 20


def test_coordinates_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        rates = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
            both = int(share * 200)
            rest = (200 - both) // 2
            a, b = np.unique(pool[: both + rest]), np.unique(np.concatenate((pool[:both], pool[200 : 200 + 200 - both - rest])))
            m = circulant.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 140)
            rates.append((m[:, 0] == m[:, 1]).mean())
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(rates) - alike) < 0.02


def test_bounds_of_missing():
    assert (1 - 0.8**circulant.ROWS) ** circulant.bands_for(80) <= circulant.MISS
    assert 60 < circulant.least_matches(140, 80) < 100


def test_query_on_a_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    sets = {i: shingles(t, 2) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        links += [(i, j) for j, k in common.items() if 100 * k >= 80 * (len(s) + len(sets[j]) - k)]
    want = components(sets, links)
    got = queries.op12_circulant_minhash(spark, path).collect()
    assert {r.doc_id: r.component_id for r in got} == want and all(r.kept == (r.doc_id == want[r.doc_id]) for r in got)
