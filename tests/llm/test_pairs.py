import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.helpers import components, edge_cases, empty_docs, shingles
from veilspark.llm import decontaminate, line_dedup, ngram_join, set_groups, sigtree
from veilspark.llm.components import connected_components
from veilspark.llm.stage import Scratch


def brute(texts, percent=80):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(ids, links), {i: len(s) for i, s in sets.items()}


def near_copies(seed, n, base_words=60, edits=4):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_join_equals_brute_force(spark):
    texts = dict(enumerate(near_copies(1, 60) + near_copies(2, 40, edits=8) + [f"only {i} of its kind here" for i in range(30)] + ["a b", "a b", "", " "]))
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    comp, sizes = brute(texts)
    assert {r.doc_id: r.component_id for r in got} == comp
    assert {r.doc_id: r.n_shingles for r in got} == sizes


@pytest.mark.parametrize("rounds", [0, 2])
def test_join_through_trees_and_blocks(spark, monkeypatch, rounds):
    monkeypatch.setattr(set_groups, "ROUNDS", rounds)
    monkeypatch.setattr(set_groups, "BLOCK", 7)
    texts = dict(enumerate(near_copies(5, 45, edits=6)))
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(texts)[0]


def test_join_equals_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    by_shingle, links = {}, []
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = set()
    for ids in by_shingle.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        links.append((a, b))
    assert got == components(sorted(texts), links)


def test_prefixes_share_a_key():
    """Of two sets at the threshold, whatever the levels, the prefixes meet."""
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 20, ngram_join.CELLS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        common = int(np.ceil(0.8 * n))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[:common], pool[n : n + int(rng.integers(0, 3))])))
        keys, bounds = ngram_join.prefixes(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), levels, 80, 100)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(keys[: bounds[1]], keys[bounds[1] :]))


def test_trees_find_the_links_and_hot_sets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(set_groups, "TESTS_PER_SET", 3)
    texts = {f"{k:03d}": t for k, t in enumerate(near_copies(7, 50, edits=3) + near_copies(8, 5))}
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(texts)[0]


def test_join_edge_cases(spark):
    got = ngram_join.jaccard_components(edge_cases(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(got) == edge_cases(spark).count()
    assert by[0] == by[1][:0] + [(0, 0)] and by[2] == [(0, 2)] and by[3] == [(1, 3)]
    assert by[4] == [(1, 4), (1, 4)] and by[5] == [(1, 4)] and by[6] == [(1, 4)]
    assert len(by[None]) == 2 and (0, None) in by[None]
    assert ngram_join.jaccard_components(empty_docs(spark)).count() == 0
    kept = ngram_join.one_per_group(edge_cases(spark))
    assert {5, 6}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.columns == edge_cases(spark).columns


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(60, 80)], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)))) for _ in range(120)]
    sizes, maps = np.array([len(s) for s in sets]), np.stack([sigtree.bitmap(s) for s in sets])
    tree = sigtree.SignatureTree(sizes, maps, np.arange(120))
    found = {frozenset((int(a), int(b))) for i, j, _ in sigtree.dual_traversal(tree, None, 80, 100) for a, b in zip(i, j)}
    for a in range(120):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                assert frozenset((a, b)) in found


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(df.where("false"), "a", "b", Scratch(spark, "t")).count() == 0


def test_line_dedup_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    key = lambda x: x.strip(line_dedup.SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = {}
    for i, t in texts.items():
        for k in {key(x) for x in t.split("\n")}:
            seen.setdefault(k, set()).add(i)
    for r in line_dedup.drop_repeated_lines(docs, min_docs=3).collect():
        lines = texts[r.doc_id].split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < 3]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_line_dedup_edge_cases(spark):
    docs = edge_cases(spark, *["Same Line \nown"] * 3)
    out = line_dedup.drop_repeated_lines(docs, min_docs=3)
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == docs.count() and rows[0].text == "" and rows[0].n_lines == 1
    assert rows[10].text == "own" or rows[10].text == ""  # "own" is in three documents as well
    assert rows[10].n_dropped == 2 and set(docs.columns) - {"n_lines"} <= set(out.columns)
    assert line_dedup.drop_repeated_lines(empty_docs(spark)).count() == 0


def item(seed, n):
    rng = random.Random(seed)
    return [f"t{rng.randrange(900)}" for _ in range(n)]


def test_leaks(spark):
    items = spark.createDataFrame([(k, " ".join(item(k, 20 + k))) for k in range(12)] + [(50, "too short"), (51, None), (None, "x " * 9)], "item_id long, text string")
    rng = random.Random(9)
    rows = []
    for k in range(12):
        t = item(k, 20 + k)
        for _ in range(int(0.2 * len(t)) if k % 2 else 0):
            t[rng.randrange(len(t))] = "changed"
        rows.append((k, f"intro words {k} " + " ".join(t).upper() + "!! tail of the text"))
    rows += [(100, "clean text with other words " * 30), (101, None), (102, ""), (103, " ".join(item(0, 20)[:10]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items).collect()}
    assert {k for k, _ in got} == set(range(12)) and all(d == i for d, i in got)
    assert got[(0, 0)].edits == 0 and got[(0, 0)].word_start == 3 and got[(1, 1)].similarity >= 0.8
    assert {r.doc_id for r in decontaminate.drop_leaking(docs, items).collect()} == {100, 101, 102, 103}


@pytest.mark.parametrize("indels", [False, True])
def test_leak_recall_at_the_limit(indels):
    rng = random.Random(11)
    vocab = np.random.default_rng(3).integers(1, 2**62, 2000).astype(np.uint64)
    items = [np.array([vocab[rng.randrange(2000)] for _ in range(rng.randint(10, 50))], np.uint64) for _ in range(80)]
    index = decontaminate.ItemIndex(np.arange(80), items, 0.2)
    hit = total = 0
    for q, it in enumerate(items):
        t = list(it)
        for k in range(int(0.2 * len(it)) // (2 if indels else 1) * (2 if indels else 1)):
            if not indels:
                t[rng.randrange(len(t))] = np.uint64(rng.randrange(2**62))
            elif k % 2:
                del t[rng.randrange(len(t))]
            else:
                t.insert(rng.randrange(len(t)), np.uint64(rng.randrange(2**62)))
        body = np.array([np.uint64(rng.randrange(2**62)) for _ in range(20)] + t + [np.uint64(rng.randrange(2**62)) for _ in range(20)], np.uint64)
        found = {i for _, items_, _ in index.matches(index.lookup(body), np.zeros(len(body), np.int64)) for i in items_}
        total, hit = total + 1, hit + (q in found)
    assert hit >= 0.95 * total


def test_leak_edge_cases(spark):
    items = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "item_id long, text string")
    got = decontaminate.find_leaks(edge_cases(spark), items).collect()
    assert sorted(r.doc_id for r in got) == [4, 4, 5, 6]
    assert decontaminate.find_leaks(empty_docs(spark), items).count() == 0
    assert decontaminate.find_leaks(edge_cases(spark), items.where("false")).count() == 0


def test_short_items_and_string_ids(spark):
    items = spark.createDataFrame([("one", "alpha"), ("two", "beta gamma"), ("four", "a b c d"), ("none", " !! "), ("five", "p q r s t")], "item_id string, text string")
    docs = spark.createDataFrame(
        [("007", "x Alpha, y beta gamma"), ("7", "beta x gamma alphas"), ("z", "a b c d a b c d"), ("e", "q r s t"), ("f", "p q r s X p q Y s t"), (None, "alpha"), ("n", None)], "doc_id string, text string"
    )
    got = sorted((str(r.doc_id), r.item_id, r.word_start, r.n_words, r.edits) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [("007", "one", 1, 1, 0), ("007", "two", 3, 2, 0), ("None", "one", 0, 1, 0), ("f", "five", 0, 5, 1), ("z", "four", 0, 4, 0)]
    leak = docs.withColumnRenamed("text", "leak")
    assert sorted(str(r.doc_id) for r in decontaminate.drop_leaking(leak, items, text_col="leak").collect()) == ["7", "None", "e", "n"]


def test_leaks_by_brute_force(spark):
    """Every (document, item) pair within the edit limit that plain dynamic programming finds, and none else."""
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(60)]
    items = {k: [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 9, 14, 25]))] for k in range(14)}
    texts = {}
    for d in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        if d % 2:
            t = list(items[rng.randrange(14)])
            for _ in range(rng.randrange(0, len(t) // 5 + 2)):
                t[rng.randrange(len(t))] = "other"
            body[len(body) // 2 : len(body) // 2] = t
        texts[d] = body

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for d, body in texts.items():
        for k, it in items.items():
            n, most = len(it), int(0.2 * len(it))
            found = [(distance(body[s : s + n], it), s) for s in range(len(body) - n + 1)]
            if found and min(found)[0] <= most:
                want[d, k] = min(found)
    docs = spark.createDataFrame([(d, " ".join(b)) for d, b in texts.items()], "doc_id long, text string")
    given = spark.createDataFrame([(k, " ".join(it)) for k, it in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.word_start) for r in decontaminate.find_leaks(docs, given).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[key][0] == want[key][0] for key in got) or sum(got[k] == want[k] for k in got) >= 0.9 * len(got)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(5)
    sym = rng.integers(0, 4, 300)
    items = [rng.integers(0, 4, 12) for _ in range(20)]
    start = rng.integers(0, 280, 20)
    got = decontaminate.edit_distances(sym, start, items, np.arange(20))
    assert list(got) == [plain(sym[s : s + 12], x) for s, x in zip(start, items)]
