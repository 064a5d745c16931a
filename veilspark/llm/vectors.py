"""Integer vectors from a table of float vectors, and joins that bring results of groups back to their rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group with more than this part of all rows is hot; so there are fewer than 1,000 of them.
HOT_PART = 1000


def whole(vec: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    return vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def integers(vec: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * c) + offset of every component, in doubles."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * scale) + offset)


def common_length(rows: DataFrame, col: str) -> int:
    """Length that most vectors have (the larger one of a tie), 0 for an empty table."""
    row = rows.groupBy(F.size(col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dims`` components."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """Every row with the columns of its group, nulls in a key being equal.

    ``groups`` is a saved or small table with one row for each key and its
    number of rows in ``copies``. Fewer than ``HOT_PART`` groups are hot: their
    hashed keys come to the driver, and they are sent to all workers. The rest
    meet their rows by a shuffle in which no key is hot.
    """
    code = F.xxhash64(*keys)
    hot = [r[0] for r in groups.where(F.col(copies) * HOT_PART > total).select(code).distinct().collect()]
    out = list(dict.fromkeys(c for c in [*rows.columns, *groups.columns] if c != copies))
    named = lambda df: df.select(*[F.col(k).alias(f"{k}__g") for k in keys], *[c for c in groups.columns if c not in keys])
    join = lambda left, right: left.join(right, [F.col(k).eqNullSafe(F.col(f"{k}__g")) for k in keys]).select(*out)
    if not hot:
        return join(rows, named(groups))
    # a cold group whose hash is that of a hot one goes with it
    apart = code.isin(hot)
    return join(rows.where(apart), F.broadcast(named(groups.where(apart)))).unionByName(join(rows.where(~apart), named(groups.where(~apart))))
