"""Embedding whitening by a weighted covariance of the distinct vectors.

Components become integers, and rows with one integer vector are one row of the
fit list, weighted by their number or by one. The covariance is a centred,
weighted product of matrices in every task, added up by Spark; its eigenvectors
(a matrix of the vector's length) are found on the driver. Each distinct vector
is whitened once and joined back to its rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors
from .stage import Scratch

#: Sums of tasks that are added together in a first step.
LOTS = 64
#: Share of the variance under which a component has none: rounding alone gives as much.
NO_VARIANCE = 1e-13


def _add(table: pa.Table) -> pa.Table:
    """Sum of the rows of one (i, lot)."""
    rows = table.column("row").combine_chunks()
    total = vectors.matrix(rows, len(rows) and len(rows[0])).sum(axis=0)
    return pa.table({"i": table.column("i").slice(0, 1).cast(pa.int32()), "lot": pa.array([0], pa.int32()), "row": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Matrix whose row i is the sum of all rows i of ``parts``, in two steps."""
    schema = "i int, lot int, row array<double>"
    found = parts.groupBy("i", "lot").applyInArrow(_add, schema).groupBy("i").applyInArrow(_add, schema).collect()
    out = np.zeros((max((r["i"] + 1 for r in found), default=0), size))
    for r in found:
        out[r["i"]] = r["row"]
    return out


def _rows(matrix: np.ndarray) -> pa.RecordBatch:
    lot = TaskContext.get().partitionId() % LOTS
    n = len(matrix)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, lot, np.int32)), pa.array(matrix.tolist(), pa.list_(pa.float64()))], names=["i", "lot", "row"])


def _gram(size: int, centred):
    """Sums over the rows (weight, vector) of a task: weighted products of the centred components."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = centred(vectors.matrix(batch.column(1), size))
            total += (x * batch.column(0).to_numpy()[:, None]).T @ x
        yield _rows(total)

    return run


def _totals(size: int):
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += batch.column(0).to_numpy() @ vectors.matrix(batch.column(1), size)
        yield _rows(total[None, :])

    return run


def _integer_totals(size: int):
    """Weighted sums of the components, exact: decimal digits by place."""

    def run(batches):
        total = np.zeros(size, object)
        for batch in batches:
            w, x = batch.column(0).to_numpy(), vectors.matrix(batch.column(1), size)
            kind = np.int64 if float(np.abs(x).max(initial=0)) * float(w.sum()) < 1 << 62 else object
            total += (x.astype(kind) * w.astype(kind)[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array([str(v) for v in total])], names=["i", "total"])

    return run


class Whitening:
    """Centre, components and scales of a fit; ``n`` is the sum of the weights, ``sums`` those of the components."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = float(np.trace(covariance))
        self.values, self.axes = values[order], axes[:, order]
        self.live = self.values > NO_VARIANCE * self.trace

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        far = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if far < 1 << 63 else object
        return x.astype(kind) * kind(self.n) - np.array(self.sums, kind) if kind is np.int64 else x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum of the squared differences of each row, exact."""
        d = self.differences(x)
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 1 << 62:
            d = d.astype(object)
        return (d * d).sum(axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components without variance are NaN."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1)), np.nan)
        return self.centred(x) @ self.axes / scale

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]


def fit(distinct: DataFrame, dims: int, *, components: int, weight: str) -> Whitening:
    """Of the rows of ``distinct`` (copies, x); weight is "one" or "count"."""
    if weight not in ("one", "count"):
        raise ValueError('weight is "one" or "count"')
    listed = distinct.select((F.lit(1).cast("long") if weight == "one" else F.col("copies")).alias("w"), "x")
    n = listed.agg(F.sum("w")).first()[0]
    found = listed.mapInArrow(_integer_totals(dims), "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect()
    sums = [0] * dims
    for r in found:
        sums[r["i"]] = int(r["t"])
    centre = Whitening(n, sums, np.zeros((dims, dims)), 0)
    total = _added(listed.mapInArrow(_gram(dims, centre.centred), "i int, lot int, row array<double>"), dims)
    return Whitening(n, sums, total / n, components)


def _whiten(model: Whitening, dims: int):
    def run(batches):
        for batch in batches:
            x = vectors.matrix(batch.column(3), dims)
            far = model.deviations(x)
            exact = pa.array(far).cast(pa.decimal128(38, 0)) if far.dtype != object else pa.array([Decimal(int(v)) for v in far], pa.decimal128(38, 0))
            white = pa.array(model.whitened(x).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), exact, white], names=["h", "g", "copies", "deviation", "white"])

    return run, "h long, g long, copies long, deviation decimal(38,0), white array<double>"


def identity_error(white: DataFrame, model: Whitening, weight: str) -> float:
    """Largest absolute entry of the whitened list's covariance minus the identity, over the components with variance."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return 0.0
    size = len(model.live)
    listed = white.select((F.lit(1).cast("long") if weight == "one" else F.col("copies")).alias("w"), "white")
    mean = _added(listed.mapInArrow(_totals(size), "i int, lot int, row array<double>"), size)[0] / model.n
    cov = _added(listed.mapInArrow(_gram(size, lambda x: x - mean), "i int, lot int, row array<double>"), size) / model.n
    return float(np.abs(cov[np.ix_(live, live)] - np.eye(len(live))).max())


def whiten(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, components: int = 16, scale: int = 64, offset: int = 1_000_000, weight: str = "one"
) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), for each row with a whole vector and each component.

    Components of vectors become x = floor(``scale`` * c) + ``offset``; n and S
    are the weights and weighted sums of the distinct x vectors, with their
    number of rows as weight or one. deviation is the sum over dimensions of
    (n * x - S)^2, exact, a decimal of 38 digits. whitened is (x - S / n) on the
    component over the root of its eigenvalue, explained the eigenvalue's share.

    Null vectors and vectors with null or non-finite components have no row.
    Rows that repeat an id, and null ids, are rows of their own. Vectors whose
    length is not the table's most common one have no row. There are as many
    components as dimensions, at most ``components``; one without variance (a
    share of at most 1e-13: fewer distinct vectors than dimensions, constant
    columns) has whitened null, and identity_error leaves it out (0 where none
    has variance); explained is null where there is no variance at all. Equal
    eigenvalues are in the order and on the axes that the solver gives, the same
    for all rows. Components beyond 64 bits saturate there. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    Intermediate tables stay in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "whitening")
    vec = F.col(vec_col)
    x = vectors.integers(vec, scale, offset)
    rows = df.where(vectors.whole(vec)).select(F.col(id_col).alias("id"), x.alias("x"))
    # two hashes with different seeds name a vector where its rows are joined back
    rows = scratch.save(rows.select("id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g")), "integers")
    dims = vectors.common_length(rows, "x")
    rows = rows.where(F.size("x") == dims)
    if not dims:
        kind = T.StructType([df.schema[id_col], *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
        return spark.createDataFrame([], kind)
    distinct = scratch.save(rows.groupBy("h", "g", "x").agg(F.count("*").alias("copies")).select("h", "g", "copies", "x"), "distinct")
    model = fit(distinct, dims, components=min(components, dims), weight=weight)
    run, schema = _whiten(model, dims)
    white = scratch.save(distinct.mapInArrow(run, schema), "whitened")
    error = identity_error(white, model, weight)
    joined = vectors.join_back(rows.select("id", "h", "g"), white, ["h", "g"], "copies", rows.count())
    one = joined.select("id", "deviation", F.posexplode("white").alias("k", "white"))
    shares = F.array(*[F.lit(v).cast("double") for v in model.explained()])
    return one.select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.nanvl("white", F.lit(None).cast("double")).alias("whitened"),
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
