"""Line dedup: lines found in many documents are dropped from every document.

Lines are exploded, normalised and hashed with built-in functions; the number
of distinct documents per hash is counted in two steps with map-side combining,
so that a line found everywhere is one row per task before the shuffle. The
hashes over the threshold come back to each document as a list of its own
repeated lines, and the other lines are joined again by position.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import Scratch, unused_name

SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_key(line: Column) -> Column:
    """The line without space characters at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _UPPER.lower())


def _hashes(text: Column, min_chars: int) -> Column:
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key)
    long_enough = F.filter(keys, lambda k: F.length(k) >= min_chars)
    return F.array_distinct(F.transform(long_enough, lambda k: F.xxhash64(k)))


def _assemble(at: int):
    """Replaces column ``at`` by the text without its hot lines and appends the counts."""

    def run(batches):
        for batch in batches:
            *columns, hot = batch.columns
            texts, n_lines, n_dropped = [], [], []
            for text, hashes in zip(columns[at], hot, strict=True):
                lines = (text.as_py() or "").split("\n")
                n_lines.append(len(lines))
                if hashes.is_valid:
                    drop = set(hashes.as_py())
                    kept = [x for x in lines if _signed_hash(x) not in drop]
                else:
                    kept = lines
                n_dropped.append(len(lines) - len(kept))
                texts.append("\n".join(kept))
            columns[at] = pa.array(texts, pa.string())
            names = [*batch.schema.names[:-1], "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)

    return run


def _signed_hash(line: str) -> int:
    """What Spark's xxhash64 gives for the line's key."""
    h = xxhash.xxh64_intdigest(line.strip(SPACE).encode().translate(_TABLE), seed=42)
    return h - (1 << 64) if h >> 63 else h


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """``docs`` with its text rebuilt, plus n_lines (before) and n_dropped.

    A line goes if its key has at least ``min_chars`` code points and is found
    in at least ``min_docs`` distinct ids. Null or empty texts are one empty
    line, which stays. Rows that repeat an id are one document; null ids count
    as one document together. A column of ``docs`` named n_lines or n_dropped
    is left out of the result; all others keep their names. An empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.drop("n_lines", "n_dropped")
    key, lines = unused_name(docs, "dropped_from"), unused_name(docs, "dropped")
    pairs = scratch.save(docs.select(F.col(id_col).alias("doc"), F.explode(_hashes(F.col(text_col), min_chars)).alias("h")), "lines")
    hot = pairs.groupBy("h", "doc").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h")
    hot = scratch.save(hot, "hot")
    own = pairs.join(hot, "h").groupBy("doc").agg(F.collect_set("h").alias(lines)).withColumnRenamed("doc", key)
    joined = docs.join(own, docs[id_col].eqNullSafe(own[key]), "left").select(*[docs[c] for c in docs.columns], own[lines])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_assemble(docs.columns.index(text_col)), schema)
