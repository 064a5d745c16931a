"""Vector codes: product quantisation in integers, nearest entries by the Walsh-Hadamard transform.

Vectors become integers and are cut into equal parts; each part position has
its own codebook. The nearest entry of a part is found in the Walsh-Hadamard
domain: parts and entries are zero-padded to a power of two L and transformed
(integers stay integers), so that the sum of squared differences is L times the
squared Euclidean distance. Differences are added up in sequency order, the
slowly varying coefficients first; an entry whose sum so far exceeds the whole
distance of some other entry is out. Nothing is rounded, so ties and results
are those of a full search.

Each round is one pass over the saved integer vectors: tasks assign parts and
give sums and counts by (part, entry, place), which Spark adds up. The driver
sees ``entries`` times the vector's length numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors
from .stage import Scratch

#: Rows of a batch that are searched together.
LOT = 4096


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Transform along the last axis, whose length is a power of two, in sequency order."""
    n = x.shape[-1]
    y = x.reshape(-1, n).copy()
    half = 1
    while half < n:
        pairs = y.reshape(len(y), -1, 2, half)
        y = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(y), n)
        half *= 2
    return y[:, sequency_order(n)].reshape(x.shape)


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes."""
    bits = np.arange(n)
    signs = np.bitwise_count(bits[:, None] & bits[None, :]) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def padded(x: np.ndarray) -> np.ndarray:
    """Zeros up to the next power of two in the last axis."""
    size = 1 << max(x.shape[-1] - 1, 0).bit_length()
    out = np.zeros((*x.shape[:-1], size), x.dtype)
    out[..., : x.shape[-1]] = x
    return out


def exact_type(largest: int, size: int) -> type:
    """int64 where size * size * (2 * largest)**2 fits, else Python's integers."""
    return np.int64 if size * size * 4 * largest * largest < 1 << 63 else object


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point (the lower one of a tie) and the squared distance; both transformed."""
    n, size = points.shape
    row = np.repeat(np.arange(n), len(entries))
    entry = np.tile(np.arange(len(entries)), n)
    sums = ((points[:, :1] - entries[:, 0]) ** 2).ravel()
    guess = np.argmin(sums.reshape(n, -1), axis=1)
    bound = ((points - entries[guess]) ** 2).sum(axis=1)
    for k in range(1, size):
        alive = sums <= bound[row]
        if not alive.all():
            row, entry, sums = row[alive], entry[alive], sums[alive]
        sums = sums + (points[row, k] - entries[entry, k]) ** 2
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if n else np.zeros(0, np.int64)
    least = np.minimum.reduceat(sums, first) if n else sums
    tie = np.flatnonzero(sums == least[row]) if n else first
    best = tie[np.unique(row[tie], return_index=True)[1]]
    return entry[best], sums[best] // size


class Codebooks:
    """Entries of every part position: (parts, entries, width) integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.count, self.width = entries.shape

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) nearest entries and squared distances of rows of integers, padded to whole parts."""
        cut = np.zeros((len(x), self.parts * self.width), x.dtype)
        cut[:, : x.shape[1]] = x
        cut = cut.reshape(len(x), self.parts, self.width)
        size = padded(self.entries[:1, :1]).shape[-1]
        kind = exact_type(max(int(np.abs(cut).max(initial=0)), int(np.abs(self.entries).max(initial=0))), size)
        codes, errors = np.zeros(cut.shape[:2], np.int64), np.zeros(cut.shape[:2], kind)
        points = walsh_hadamard(padded(cut.astype(kind)))
        books = walsh_hadamard(padded(self.entries.astype(kind)))
        for p in range(self.parts):
            codes[:, p], errors[:, p] = nearest(points[:, p], books[p])
        return codes, errors

    def moved(self, sums: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
        """Entries at the floor of their parts' means; ``sums`` has (sum, count) by part, entry and place."""
        out = self.entries.astype(object)
        for (p, e, k), (total, count) in sums.items():
            out[p, e, k] = total // count
        return Codebooks(_small(out))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.entries.ravel()).encode()).hexdigest()


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if x.size and all(-(1 << 62) < v < 1 << 62 for v in x.ravel()) else x


def start_codebooks(first: list[list[int]], parts: int, dims: int) -> Codebooks:
    """Part by part the given vectors; a last part that is too short ends in zeros."""
    width = -(-dims // parts)
    x = np.zeros((len(first), parts * width), np.int64)
    x[:, :dims] = first
    return Codebooks(x.reshape(len(first), parts, width).transpose(1, 0, 2).copy())


def _sums(books: Codebooks, dims: int):
    def run(batches):
        total = np.zeros(books.entries.shape, object)
        count = np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            every = vectors.matrix(batch.column(0), dims)
            for a in range(0, len(every), LOT):
                x = every[a : a + LOT]
                codes, _ = books.assign(x)
                cut = np.zeros((len(x), books.parts * books.width), np.int64)
                cut[:, :dims] = x
                cut = cut.reshape(len(x), books.parts, books.width)
                kind = np.int64 if int(np.abs(cut).max(initial=0)) < 1 << 50 else object
                for p in range(books.parts):
                    own = np.zeros((books.count, books.width), kind)
                    np.add.at(own, codes[:, p], cut[:, p].astype(kind))
                    total[p] += own
                    count[p] += np.bincount(codes[:, p], minlength=books.count)
        p, e = np.nonzero(count)
        if len(p):
            place = np.tile(np.arange(books.width, dtype=np.int32), len(p))
            wide = lambda v: np.repeat(v, books.width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wide(p).astype(np.int32)), pa.array(wide(e).astype(np.int32)), pa.array(place), pa.array([str(v) for v in total[p, e].ravel()]), pa.array(wide(count[p, e]))],
                names=["part", "entry", "place", "total", "n"],
            )

    return run, "part int, entry int, place int, total string, n long"


def _codes(books: Codebooks, dims: int):
    def run(batches):
        for batch in batches:
            every = vectors.matrix(batch.column(2), dims)
            for a in range(0, len(every), LOT):
                codes, errors = books.assign(every[a : a + LOT])
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * books.parts
                total = [int(v) if int(v) < 1 << 63 else None for v in errors.sum(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, LOT), batch.column(1).slice(a, LOT), pa.array([text[k : k + step] for k in range(0, len(text), step)]), pa.array(total, pa.int64())],
                    names=["id", "lab", "code", "error"],
                )

    return run


def train(rows: DataFrame, dims: int, *, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks after ``rounds`` passes over ``rows`` (id, x)."""
    first = [r["x"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    books = start_codebooks(first, parts, dims)
    for _ in range(rounds):
        run, schema = _sums(books, dims)
        sums = rows.select("x").mapInArrow(run, schema).groupBy("part", "entry", "place")
        found = sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        books = books.moved({(r["part"], r["entry"], r["place"]): (int(r["total"]), r["n"]) for r in found})
    return books


def integer_rows(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Saved rows (id, lab, x) of the whole vectors, and their length."""
    vec = F.col(vec_col)
    rows = df.where(vectors.whole(vec)).select(F.col(id_col).alias("id"), label.alias("lab"), vectors.integers(vec, scale).alias("x"))
    rows = scratch.save(rows, "integers")
    dims = vectors.common_length(rows, "x")
    return rows.where(F.size("x") == dims), dims


def compress(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256) of every vector that is whole.

    Components become floor(``scale`` * c). Each part position's codebook starts
    as that part of the ``entries`` smallest ids and moves ``rounds`` times to
    the floor of the means; entries without parts stay. Ties go to the lower
    index. ``code`` has two hex digits for each part (at most 256 entries).

    Null vectors and vectors with null or non-finite components have no row.
    Rows that repeat an id are rows of their own; those with one id start by
    their vectors in order, null ids after all others. Fewer vectors than
    entries: as many entries as vectors. Vectors whose length is not the table's
    most common one have no row; a length that ``parts`` does not divide ends in
    zeros. Components beyond 64 bits saturate there; an error that does not fit
    a long is null, and label_error then adds up the others. Null labels are one
    label. Other columns are ignored, whatever their names. An empty table gives
    an empty result. Intermediate tables stay in ``spark.checkpoint.dir``.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    spark = df.sparkSession
    scratch = Scratch(spark, "vector-codes")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows, dims = integer_rows(df, id_col, vec_col, label, scale, scratch)
    kinds = [rows.schema["id"], rows.schema["lab"]]
    schema = T.StructType([*kinds, *T.StructType.fromDDL("code string, error long").fields])
    if dims:
        books = train(rows, dims, parts=parts, entries=entries, rounds=rounds)
        scored = scratch.save(rows.select("id", "lab", "x").mapInArrow(_codes(books, dims), schema), "codes")
        digest = books.sha256()
    else:
        scored, digest = spark.createDataFrame([], schema), hashlib.sha256(b"").hexdigest()
    totals = scored.groupBy("lab").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies"))
    out = vectors.join_back(scored, totals, ["lab"], "copies", scored.count())
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
