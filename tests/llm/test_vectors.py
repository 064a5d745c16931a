import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veilspark.llm import queries, vector_codes, vectors, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string, h string, component string, copies string, lab string, n long"


def frame(spark, rows):
    """Rows (id, vector, label) with columns whose names clash with those inside."""
    return spark.createDataFrame([(i, v, lab, "c", "x", "h", "k", "m", "l", 7) for i, v, lab in rows], SCHEMA)


def some(seed=0, n=60, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)).astype(np.float32)
    base[n // 2 :] = np.round(base[n // 2 :] * 2) / 2
    base[-n // 4 :] = base[0]
    return [(k, [float(v) for v in row], None if k % 5 == 0 else k % 3) for k, row in enumerate(base)]


CASES = [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [NAN] + [0.0] * 15, 2), (903, [INF] * 16, 2), (904, [-INF] + [0.0] * 15, None), (905, [0.5, 1.5], 0), (906, [], 0)]


def kept(rows, d):
    return [(i, v, lab) for i, v, lab in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract, entry by entry in plain integers."""
    rows = sorted(rows, key=lambda r: r[0])
    x = {i: [math.floor(scale * c) for c in v] for i, v, _ in rows}
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(x[r[0]], p) for r in rows[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((u - w) ** 2 for u, w in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for v in x.values():
            for p in range(parts):
                groups[p][near(v, p)].append(cut(v, p))
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(gs, b, strict=True)] for gs, b in zip(groups, books, strict=True)]
    out, by_label = {}, {}
    for i, _, lab in rows:
        codes = [near(x[i], p) for p in range(parts)]
        error = sum(dist(cut(x[i], p), books[p][c]) for p, c in enumerate(codes))
        out[i] = ["".join(f"{c:02x}" for c in codes), error, lab]
        by_label[lab] = by_label.get(lab, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (code, error, by_label[lab], sha) for i, (code, error, lab) in out.items()}


def test_codes_equal_a_full_search(spark):
    rows = some()
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(frame(spark, rows + CASES)).collect()}
    assert got == brute_codes(kept(rows, 16))


@pytest.mark.parametrize("n", [1, 5, 16])
def test_codes_of_few_vectors(spark, n):
    rows = some(3, 40)[:n]
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(frame(spark, rows)).collect()}
    assert got == brute_codes(rows)


def test_walsh_hadamard_keeps_distances_in_sequency_order():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 32):
        x = rng.integers(-1000, 1000, (20, size))
        y = vector_codes.walsh_hadamard(x)
        assert ((y**2).sum(axis=1) == size * (x**2).sum(axis=1)).all()
        rows = vector_codes.walsh_hadamard(np.eye(size, dtype=np.int64)).T
        assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(size))


def test_nearest_is_exact_with_ties_and_beyond_64_bits():
    rng = np.random.default_rng(2)
    for scale, kind in ((3, np.int64), (10**12, object)):
        points, entries = (rng.integers(-scale, scale + 1, (n, 8)).astype(kind) for n in (200, 16))
        entries[5] = entries[2]
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        code, error = vector_codes.nearest(vector_codes.walsh_hadamard(points), vector_codes.walsh_hadamard(entries))
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_codes_of_parts_that_do_not_divide_large_values_and_repeats(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0), (None, [1e9, -1e9, 0.5], None), (2, [0.0, 0.0, 0.0], None)]
    got = vector_codes.compress(frame(spark, rows), parts=2, entries=2).collect()
    assert len(got) == 4 and len([r for r in got if r.vec_id == 1]) == 2 and all(len(r.code) == 4 for r in got)
    huge = vector_codes.compress(spark.createDataFrame([(k, [1e300 * k, 1.0], None) for k in range(3)], "vec_id long, embedding array<double>, label int"), parts=2, entries=1).collect()
    assert len(huge) == 3 and all(r.error is None for r in huge)
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, rows), entries=257)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert vector_codes.compress(none).count() == 0 and whitening.whiten(none).count() == 0
    assert vector_codes.compress(frame(spark, CASES[:5])).count() == 0


def brute_white(x, components=16, weights=None):
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    w = np.ones(len(distinct)) if weights is None else counts
    n, s = int(w.sum()), (distinct * w[:, None].astype(np.int64)).sum(axis=0)
    centred = distinct - s / n
    values, axes = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    return n, s, values[::-1][:components], axes[:, ::-1][:, :components], values.sum()


@pytest.mark.parametrize("weight", ["one", "count"])
def test_whitening_equals_numpy(spark, weight):
    rows = some(5, 80)
    got = whitening.whiten(frame(spark, rows + CASES), components=6, weight=weight).collect()
    x = {i: np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 10**6 for i, v, _ in kept(rows, 16)}
    n, s, values, axes, trace = brute_white(np.stack(list(x.values())), 6, None if weight == "one" else "count")
    assert len(got) == 6 * len(x) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    signs = {}
    for r in got:
        want = float((x[r.vec_id] - s / n) @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1]))
        if abs(want) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(want) * np.sign(r.whitened))
        assert abs(abs(r.whitened) - abs(want)) < 1e-8
        assert int(r.deviation) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s, strict=True))
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-12
    assert all(len(s) == 1 for s in signs.values())


def test_components_without_variance(spark):
    rows = [(1, [1.0, 5.0, 0.0], 0), (2, [2.0, 5.0, 0.0], 0), (2, [2.0, 5.0, 0.0], 0), (None, [4.0, 5.0, 0.0], 0)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 12 and {r.n for r in got} == {3}
    for r in got:
        assert (r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9
    one = whitening.whiten(frame(spark, rows[:1])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, None, 0, 0.0)] * 3


def test_deviation_is_exact_beyond_64_bits(spark):
    rows = [(k, [float(10**13 * k), 0.25], None) for k in range(3)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("component = 1").collect()}
    x = [64 * 10**13 * k for k in range(3)]
    assert got == {k: (3 * x[k] - sum(x)) ** 2 for k in range(3)}


def test_join_back_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT_PART", 3)
    rows = spark.createDataFrame([(k, None if k % 2 else k % 5) for k in range(100)], "id long, g int")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = {(r.id, r.top) for r in vectors.join_back(rows, groups, ["g"], "n", 100).collect()}
    top = {g: max(k for k in range(100) if (None if k % 2 else k % 5) == g) for g in [None, 0, 1, 2, 3, 4]}
    assert got == {(k, top[None if k % 2 else k % 5]) for k in range(100)}


def test_queries_on_a_table(spark):
    codes = queries.op11_vector_codes(spark, SF).collect()
    white = queries.op13_embedding_whitening(spark, SF).collect()
    assert len(white) == 16 * len(codes) and {r.identity_error < 1e-4 for r in white} == {True}
