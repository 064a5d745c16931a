import random

import numpy as np
import pytest

from veilspark.llm import decontaminate


def edited(rng, t, edits, indels):
    t = list(t)
    for k in range(edits):
        at = rng.randrange(len(t))
        if not indels:
            t[at] = np.uint64(rng.randrange(2**62))
        elif k % 2:
            del t[at]
        else:
            t.insert(at, np.uint64(rng.randrange(2**62)))
    return t


def recall(n, indels, count=24):
    rng = random.Random(n)
    vocab = np.random.default_rng(3).integers(1, 2**62, 2000).astype(np.uint64)
    items = [np.array([vocab[rng.randrange(2000)] for _ in range(n)], np.uint64) for _ in range(count)]
    index = decontaminate.ItemIndex(np.arange(count), items, 0.2)
    hit = 0
    for q, it in enumerate(items):
        t = edited(rng, it, int(0.2 * n) // 2 * 2 if indels else int(0.2 * n), indels)
        noise = lambda: [np.uint64(rng.randrange(2**62)) for _ in range(20)]
        body = np.array(noise() + t + noise(), np.uint64)
        hit += q in {i for _, found, _ in index.matches(index.lookup(body), np.zeros(len(body), np.int64)) for i in found}
    return hit / count


@pytest.mark.parametrize("indels", [False, True])
@pytest.mark.parametrize("n", [60, 100, 200, 400])
def test_recall_of_long_items(n, indels):
    assert recall(n, indels) == 1.0


@pytest.mark.parametrize("indels", [False, True])
def test_recall_of_a_thousand_words(indels):
    assert recall(1000, indels, 3) == 1.0


def test_best_window_of_a_long_item():
    rng = random.Random(2)
    it = np.array([rng.randrange(1, 2**62) for _ in range(120)], np.uint64)
    body = np.concatenate([it[60:], it, it[:70]])
    index = decontaminate.ItemIndex(np.arange(1), [it], 0.2)
    best = min((int(d), int(s)) for starts, _, ds in index.matches(index.lookup(body), np.zeros(len(body), np.int64)) for s, d in zip(starts, ds))
    assert best == (0, 60)
