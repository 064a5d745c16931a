"""Document fingerprints by Order MinHash (Marcais et al., 2019).

The k-mers of a text are its runs of ``K`` words, each numbered by how often it
has occurred before. For each of ``SLOTS`` hash functions the ``PICK`` k-mers
with the smallest values are taken, kept in the order of the text, and hashed
as a tuple. The share of equal slots of two fingerprints falls with the edit
distance, also where two texts have the same words in another order.

A run of over ``LONG_RUN`` bytes without white space (a text in a script that
writes none, or data) counts as a sequence of words of ``RUN_CHARS`` characters,
one from each character on, so that an edit inside it stays local.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .stage import Scratch

K, SLOTS, PICK = 3, 64, 2
LONG_RUN, RUN_CHARS = 64, 6
_rng = np.random.default_rng(8)
_A = _rng.integers(1 << 40, 1 << 62, SLOTS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 62, SLOTS, dtype=np.uint64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
PARTITION_ROWS = 20_000


def _open_runs(chunk: words.Chunk) -> words.Chunk:
    """The chunk with every long run as its overlapping pieces of characters."""
    long = np.flatnonzero(chunk.end - chunk.start > LONG_RUN)
    if not len(long):
        return chunk
    first = (chunk.data & 0xC0) != 0x80  # bytes that start a character
    begins = np.append(np.flatnonzero(first), len(chunk.data))
    a, b = np.searchsorted(begins, chunk.start[long]), np.searchsorted(begins, chunk.end[long])
    count = np.maximum(b - a - RUN_CHARS + 1, 1)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(a, count) + step
    start = begins[at]
    end = np.minimum(begins[np.minimum(at + RUN_CHARS, len(begins) - 1)], np.repeat(chunk.end[long], count))
    short = np.ones(len(chunk.start), bool)
    short[long] = False
    order = np.argsort(np.concatenate((chunk.start[short], start)), kind="stable")
    merge = lambda x, y: np.concatenate((x, y))[order]
    hashes = merge(chunk.hash[short], words.hash_spans(chunk.data, start, end))
    doc = merge(chunk.doc[short], np.repeat(chunk.doc[long], count))
    bounds = np.searchsorted(doc, np.arange(chunk.n_docs + 1))
    return words.Chunk(chunk.first, chunk.n_docs, chunk.data, chunk.offsets, doc, merge(chunk.start[short], start), merge(chunk.end[short], end), hashes, bounds)


def numbered_kmers(chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, earlier occurrences in the text) in text order, and their bounds."""
    hashes, bounds = words.shingle_hashes(chunk, K)
    number = np.zeros(len(hashes), np.uint64)
    for d in range(chunk.n_docs):
        a, b = bounds[d], bounds[d + 1]
        if b - a > 1:
            order = np.argsort(hashes[a:b], kind="stable")
            run = hashes[a:b][order]
            same = run[1:] == run[:-1]
            if same.any():
                first = np.concatenate(([True], ~same))
                place = np.arange(b - a)
                number[a:b][order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return words.mix(hashes + number * np.uint64(0x9E3779B97F4A7C15)), bounds


def order_minhash(column: pa.Array) -> np.ndarray:
    """(texts, SLOTS) 16-bit tuple hashes; texts without words have all bits set."""
    out = np.full((len(column), SLOTS), 0xFFFF, np.uint16)
    for chunk in words.word_chunks(column, limit=1 << 19):
        hashes, bounds = numbered_kmers(_open_runs(chunk))
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            continue
        cuts = bounds[full]
        size = np.diff(np.append(cuts, len(hashes)))
        # the low bits of each value give way to the place: 24, or 36 in a text with more k-mers, which has a chunk to itself
        places = np.uint64((1 << (24 if size.max() <= 1 << 24 else 36)) - 1)
        local = (np.arange(len(hashes)) - np.repeat(cuts, size)).astype(np.uint64)
        for s in range(SLOTS):
            v = (hashes * _A[s] + _B[s]) & ~places
            v |= local
            low = np.minimum.reduceat(v, cuts)
            p1 = cuts + (low & places).astype(np.int64)
            v[p1] = _TOP
            low2 = np.minimum.reduceat(v, cuts)
            p2 = np.where(low2 == _TOP, p1, cuts + (low2 & places).astype(np.int64))
            first, second = hashes[np.minimum(p1, p2)], hashes[np.maximum(p1, p2)]
            h = words.mix(words.mix(first + np.uint64(s)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F)))
            out[chunk.first + full, s] = (h >> np.uint64(48)).astype(np.uint16)
    return out


def _hex(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint) for every row; null is the empty text."""
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("x"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(order_minhash(batch.column(1))), pa.string())], names=["i", "fingerprint"])

    return base.mapInArrow(run, base.select("i").schema.add("fingerprint", "string")).withColumnRenamed("i", id_col)


_PAIR = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(pairs: list[tuple]) -> list[pa.Array]:
    """Columns ``_PAIR`` of pairs of neighbours, each (text, print)."""
    edited = []
    for (text, _), (after, _) in pairs:
        n = len(text)
        edited.append(text[: n - n // 2] + after[: n // 2])
    new = order_minhash(pa.array(edited, pa.string()))
    own, after = np.stack([a[1] for a, _ in pairs]), np.stack([b[1] for _, b in pairs])
    packed = lambda prints: pa.array([row.astype(">u2").tobytes() for row in prints], pa.binary())
    return [
        pa.array([len(a[0]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        packed(own), packed(new), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
    ]


def _within(batches):
    """Rows of one ordered range, each compared with the next one; its first and last text come out as well."""
    part, held, top = TaskContext.get().partitionId(), None, None

    def row(ids, text, top_text, columns=None):
        n = len(ids)
        columns = columns or [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), ids, pa.array(text, pa.string()), pa.array(top_text, pa.string()), *columns], names=["part", "i", "text", "top", *_NAMES])

    for batch in batches:
        texts = batch.column(1).to_pylist()
        chain = list(zip(texts, order_minhash(batch.column(1)), strict=True))
        ids = batch.column(0)
        if top is None and texts:
            top = texts[0]
        if held is not None and texts:
            ids = pa.concat_arrays([held[0], ids])
            chain = [held[1], *chain]
        if not chain:
            continue
        held = ids.slice(len(ids) - 1, 1), chain[-1]
        if len(chain) > 1:
            n = len(chain) - 1
            yield row(ids.slice(0, n), [None] * n, [None] * n, _compared(list(zip(chain, chain[1:], strict=False))))
    if held is not None:
        yield row(held[0], [held[1][0]], [top])


def _between(batches):
    """Last rows of the ranges, compared with the next range's first."""
    for batch in batches:
        if batch.num_rows:
            pairs = list(zip(*(zip(c.to_pylist(), order_minhash(c), strict=True) for c in batch.columns[1:3]), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_compared(pairs)], names=["i", *_NAMES])


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited text, and the likeness of their fingerprints.

    The next document is the one after it in descending id (after the last, the
    first); in the edited text the last half of the code points is replaced by
    the start of the next document. Rows with one id are ordered by a hash of
    their texts; null ids come last. Null texts are empty. Other columns are
    ignored, whatever their names. An empty table gives an empty result; a
    single row is its own next one.

    The texts are dealt once, by ranges of ids; each range is compared inside
    its own task, and only the first and last text of each range meet those of
    its neighbours, by a join.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    base = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    parts = max(1, -(-base.count() // PARTITION_ROWS))
    # rows of one id can be many: they are dealt by their texts and, where those are equal, by row
    order = [F.desc_nulls_last("i"), F.asc("h"), F.asc("r")]
    keyed = base.withColumns({"h": F.xxhash64("x"), "r": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("i", "x")
    kind = T.StructType([T.StructField("i", base.schema["i"].dataType), *T.StructType.fromDDL(_PAIR).fields])
    schema = T.StructType([*T.StructType.fromDDL("part int").fields, kind["i"], *T.StructType.fromDDL("text string, top string").fields, *kind.fields[1:]])
    inside = scratch.save(ordered.mapInArrow(_within, schema), "inside")
    last = inside.where("text IS NOT NULL").select("part", "i", "text", "top")
    # the next range that is not empty; after the last one the first. One small row for each range.
    by_part = Window.orderBy("part")
    least = F.min("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = last.select("part", F.coalesce(F.lead("part").over(by_part), least).alias("next"))
    tops = last.select(F.col("part").alias("next"), F.col("top").alias("after"))
    edges = last.select("part", "i", "text").join(follow, "part").join(tops, "next").select("i", "text", "after").mapInArrow(_between, kind)
    whole = inside.where("text IS NULL").select("i", *_NAMES).unionByName(edges)
    shown = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return whole.withColumns(shown).withColumnRenamed("i", id_col)
