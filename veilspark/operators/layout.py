"""Texts as positioned tokens: lines of height 20, characters of width 8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

CHAR, LINE = 8, 20
#: A whole word of a-z, none of it beside another letter, digit or underscore.
AZ_WORD = r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"
#: Bytes of texts that are laid out at once.
SLICE = 1 << 20


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Place of the first row of each row's group; groups stand together."""
    starts = np.concatenate([[True], groups[1:] != groups[:-1]])[: len(groups)]
    return np.maximum.accumulate(np.where(starts, np.arange(len(groups)), 0))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, null ones empty: row, word, number in its text, number of its line, characters before it in its line
    (one between words), and its characters."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    row = pc.list_parent_indices(lines).to_numpy()
    words = pc.ascii_split_whitespace(pc.list_flatten(lines))
    line, flat = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.greater(pc.binary_length(flat), 0)
    line, flat = line.filter(some).to_numpy(), flat.filter(some)
    size = pc.utf8_length(flat).to_numpy().astype(np.int64)
    if not len(line):
        return line, flat, line, line, size, size
    before = np.cumsum(size + 1) - size - 1
    of = row[line]
    number = line - np.searchsorted(row, of)
    return of, flat, np.arange(len(of)) - _firsts(of), number, before - before[_firsts(line)], size


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``SLICE`` bytes of text; its last column, ``__text``, has the texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, until - at)
        at = until


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for b in batches for p in slices(b)):
        row, word, number, line, before, size = words_of(part.column("__text"))
        kept = [c.take(pa.array(row)) for c in part.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in (number, line)), word, *(pa.array(v, pa.int64()) for v in (before, size))], names=[*part.schema.names[:-1], "ord", "line_no", "text", "before", "size"])


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ord, line_no, text, x, y, w, h, confidence): one row per token, ord counts from 0 in a document, with the columns
    to ``keep``.

    Arrow kernels cut the texts of a batch and number all of its words at once,
    so that no token is shuffled; words of a document stand together, in order.
    """
    given = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL("ord long, line_no long, text string, before long, size long").fields])
    placed = given.mapInArrow(_lay_out, schema)
    return placed.select(
        id_col,
        "ord",
        "line_no",
        "text",
        (F.col("before") * CHAR).alias("x"),
        (F.col("line_no") * LINE).alias("y"),
        (F.col("size") * CHAR).alias("w"),
        F.lit(LINE).cast("long").alias("h"),
        F.lit(1.0).alias("confidence"),
        *keep,
    )


def split_words(toks: DataFrame) -> DataFrame:
    """Lower-case a-z words inside each token, the token's width divided among them; tokens without one vanish."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(AZ_WORD), F.lit(0))
    cut = toks.select("*", X.only_if(words, lambda m: F.size(m) > 0).alias("words"))
    share = F.floor(F.col("w") / F.size("words"))
    wide = cut.select("*", share.alias("each"), F.posexplode("words").alias("sub", "word"))
    one = F.size("words") == 1
    return wide.select(
        *[c for c in toks.columns if c not in ("x", "w", "text")],
        F.col("sub").cast("long").alias("sub"),
        "word",
        F.when(one, F.col("x")).otherwise(F.col("x") + F.col("sub") * F.col("each")).alias("x"),
        F.when(one, F.col("w")).otherwise(F.col("each")).alias("w"),
    )


def valid_recognised(raw: DataFrame, min_confidence: float = 30) -> DataFrame:
    """Recogniser output (text, x, y, w, h, conf 0-100) without empty or doubtful tokens, confidence as a share."""
    kept = raw.where((F.btrim("text") != "") & (F.col("conf") >= min_confidence))
    return kept.withColumn("confidence", F.col("conf") / 100).drop("conf")


def corner_boxes(raw: DataFrame) -> DataFrame:
    """Boxes by corners (x1, y1, x2, y2) to x, y, w, h with sides of 1 at least."""
    w, h = F.greatest(F.col("x2") - F.col("x1"), F.lit(1)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1))
    return raw.select(*[c for c in raw.columns if c not in ("x1", "y1", "x2", "y2")], F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("w"), h.alias("h"))


def runs(toks: DataFrame, id_col: str, order: list[str], max_gap: int, min_length: int) -> DataFrame:
    """Gaps and islands: adds run (number in the document) and run_length; a run breaks where y grows by more than ``max_gap``."""
    w = Window.partitionBy(id_col).orderBy(*order)
    gap = F.abs(F.col("y") - F.lag("y").over(w)) > max_gap
    numbered = toks.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    size = F.count("*").over(Window.partitionBy(id_col, "run"))
    return numbered.withColumn("run_length", size).where(F.col("run_length") >= min_length)
