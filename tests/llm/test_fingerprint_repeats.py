import random

import pyarrow as pa

from veilspark.llm import fingerprint


def likeness(a, b):
    x, y = fingerprint.order_minhash(pa.array([a, b]))
    return fingerprint.likeness(x[None], y[None])[0]


def test_a_repeated_phrase_changes_little():
    rng = random.Random(4)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    assert likeness(" ".join(w), " ".join(w + w[:6])) > 0.85
    assert likeness(" ".join(w), " ".join(w[:150] + w[140:])) > 0.85


def test_short_and_repeated_texts():
    assert likeness("a b c", "a b c") == 1.0 and likeness("a b c", "a b d") < 0.2
    # the only 3-mer of the one is the first occurrence in the other
    hashes = [fingerprint.numbered_kmers(next(fingerprint.words.word_chunks(pa.array([t]))))[0] for t in ("a b c", "a b c a b c")]
    assert hashes[0][0] == hashes[1][0] and len(set(hashes[1].tolist())) == 4


def test_edits_inside_long_runs_stay_local():
    rng = random.Random(5)
    run = "".join(rng.choice("日本語文字列テスト漢字仮名交") for _ in range(1500))
    other = "".join(rng.choice("日本語文字列テスト漢字仮名交") for _ in range(1500))
    assert likeness(run, run[:700] + "新" + run[700:]) > 0.9 and likeness(run, other) < 0.2
    data = "".join(rng.choice("0123456789abcdef") for _ in range(3000))
    assert likeness("see " + data, "see " + data[1:]) > 0.9 and likeness(data, data[::-1]) < 0.2


def plain_signature(text, slots=fingerprint.SLOTS):
    """The signature by its definition: k-mers with occurrence numbers, the two smallest of each slot in text order."""
    import numpy as np

    u = lambda v: v & (2**64 - 1)
    chunk = next(fingerprint.words.word_chunks(pa.array([text])))
    plain, _ = fingerprint.words.shingle_hashes(chunk, fingerprint.K)
    seen, kmers = {}, []
    for h in map(int, plain):
        n = seen.get(h, 0)
        seen[h] = n + 1
        kmers.append(int(fingerprint.words.mix(np.array([u(h + n * 0x9E3779B97F4A7C15)], np.uint64))[0]))
    out = []
    for s in range(slots):
        value = lambda k: (u(kmers[k] * int(fingerprint._A[s]) + int(fingerprint._B[s])) >> 24, k)  # noqa: E731, B023
        two = sorted(sorted(range(len(kmers)), key=value)[:2])
        first, second = kmers[two[0]], kmers[two[-1]]
        h = int(fingerprint.words.mix(np.array([u(first + s)], np.uint64))[0]) ^ u(second * 0xC2B2AE3D27D4EB4F)
        out.append(int(fingerprint.words.mix(np.array([h], np.uint64))[0]) >> 48)
    return out


def test_signature_by_definition():
    rng = random.Random(6)
    for n in (1, 2, 3, 4, 40, 200):
        text = " ".join(rng.choice("a b c d e f".split()) for _ in range(n))
        assert fingerprint.order_minhash(pa.array([text]))[0].tolist() == plain_signature(text)


def test_string_ids_and_ties(spark):
    rows = [("b", "one two three four"), ("a", "five six seven"), ("a", None), ("c", "x"), (None, "last")]
    got = fingerprint.edit_sensitivity(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["None", "a", "a", "b", "c"]
    by = {r.doc_id: r for r in got}
    import hashlib

    assert by["c"].edited_sha256 == hashlib.sha256(b"x").hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(b"lax").hexdigest()  # the first row follows the last
