"""N-gram Jaccard join: word-shingle sets linked at an exact Jaccard threshold.

1. One pass over the texts counts shingles roughly, in ``CELLS`` cells, so that
   frequent ones are known, and better known the larger the corpus is. The order
   (cell's level, hash) of the shingles is the same everywhere; how well the
   cells count only decides how long the work takes.
2. One pass makes the set of distinct word shingles (64-bit hashes) of each
   text, its size, a 128-bit fingerprint of the whole set, and its keys: the
   first ``n - ceil(t n) + 1`` shingles in that order, the rarest ones. Two sets
   that reach the threshold t share a key. Texts with one fingerprint form a
   class; only classes go on, so that any number of exact copies is one row.
3. The sets that share a key are a group, which ``set_groups`` contracts and
   proves. Its signature trees (``sigtree``) are the candidate search: dual
   traversal prunes by size range, by the bound on the overlap from the
   OR-combined bitmaps, and by known components. Large sets fill those bitmaps,
   so that their pairs are bounded by wider ones. No pair that links is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import set_groups, sigtree
from .set_groups import fingerprint, shingle_sets
from .stage import Scratch, unused_name

#: Cells of the rough counts, two bytes each when sent, and those that travel together.
CELLS, CELL_BLOCK = 1 << 20, 1 << 16
#: Steps of a cell's level for each 1 of the count's root; chance moves the root by a half, however full the cells are.
STEPS = 8


def _cell(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(7)) % np.uint64(CELLS)).astype(np.int64)


def _rough_counts(width: int):
    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, hashes, _ in shingle_sets(batch.column(0), width):
                np.add.at(counts, _cell(hashes), 1)
        for a in range(0, CELLS, CELL_BLOCK):
            part = counts[a : a + CELL_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([a // CELL_BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    return run, "block int, counts binary"


def _add_counts(table: pa.Table) -> pa.Table:
    """Levels of one block of cells: the count's root, so that a repeated shingle stands out in full cells too."""
    total = np.zeros(CELL_BLOCK, np.uint64)
    for blob in table.column("counts").to_pylist():
        total += np.frombuffer(blob, np.uint32)
    level = np.minimum(np.rint(STEPS * np.sqrt(total)), 65535).astype(np.uint16)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})


def shingle_levels(base: DataFrame, width: int) -> np.ndarray:
    """Level of each cell: two bytes for each of ``CELLS`` at any size of the corpus."""
    run, schema = _rough_counts(width)
    rows = base.mapInArrow(run, schema).groupBy("block").applyInArrow(_add_counts, "block int, levels binary").collect()
    levels = np.zeros(CELLS, np.uint16)
    for r in rows:
        levels[r["block"] * CELL_BLOCK : (r["block"] + 1) * CELL_BLOCK] = np.frombuffer(r["levels"], np.uint16)
    return levels


def prefixes(hashes: np.ndarray, bounds: np.ndarray, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, concatenated, and their bounds."""
    size = np.diff(bounds)
    count = np.where(size > 0, size - -(-num * size // den) + 1, 0)
    own = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((hashes, levels[_cell(hashes)], own))
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], size)
    return hashes[order][place < np.repeat(count, size)], np.concatenate(([0], np.cumsum(count)))


def _signatures(width: int, num: int, den: int, get):
    def run(batches):
        levels = get()
        for batch in batches:
            ids = batch.column(0)
            for first, hashes, bounds in shingle_sets(batch.column(1), width):
                sizes = np.diff(bounds)
                fps = [fingerprint(hashes[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                keys, ends = prefixes(hashes, bounds, levels, num, den)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
                bits = [sigtree.bitmap(hashes[a:b]).tobytes() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                wide = [set_groups.wide_bitmap(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [ids.slice(first, len(sizes)), pa.array(sizes), pa.array(fps, pa.binary()), lists, pa.array(bits, pa.binary()), pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "fp", "keys", "payload", "wide"])

    return run


class TreeSearch:
    """Signature trees of the rows of a task."""

    def __init__(self, n, payload, comp, num: int, den: int):
        self.n, self.comp, self.num, self.den = n.astype(np.int64), comp, num, den
        self.maps = np.frombuffer(b"".join(payload), np.uint64).reshape(len(n), -1)
        excess = self.n - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        self.leaves = (self.maps, self.n, self.n, excess, comp)

    def check(self, i, j):
        """Leaf by leaf, for groups that make a tree of one node."""
        keep, bound = sigtree.survivors(self.leaves, self.leaves, i, j, self.num, self.den)
        return np.flatnonzero(keep), bound

    def _tree(self, rows):
        return sigtree.SignatureTree(self.n[rows], self.maps[rows], self.comp[rows])

    def across(self, a, b):
        return sigtree.dual_traversal(self._tree(a), None if b is None else self._tree(b), self.num, self.den)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80
) -> DataFrame:
    """Rows (id, n_shingles, component_id, class_size) for every row of ``docs``.

    Two texts link when ``100 * |A & B| >= percent * |A | B|`` of their sets of
    distinct word shingles. component_id is the smallest id reachable by links.
    Ids can be of any type that has an order.

    Null and empty texts, or texts without words: n_shingles 0, linked with
    nothing, component_id their own id. Texts with fewer words than ``width``
    have one shingle, the whole sequence. Rows that repeat an id are rows of
    their own with that id; null ids are kept and never chosen over an id.
    Other columns of ``docs`` are ignored, whatever their names. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    num, den = percent, 100
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("txt"))
    levels = spark.sparkContext.broadcast(shingle_levels(base.select("txt"), width))
    schema = T.StructType([base.schema["doc"], *T.StructType.fromDDL("n long, fp binary, keys array<long>, payload binary, wide binary").fields])
    rows, classes = set_groups.save_classes(base.mapInArrow(_signatures(width, num, den, lambda: levels.value), schema), scratch)
    named = set_groups.class_components(classes, base, width, lambda n, payload, comp: TreeSearch(n, payload, comp, num, den), num, den, scratch)
    out = set_groups.to_rows(rows, named, scratch)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "class_size")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest.

    Rows with a null id are kept. Rows that repeat an id are one document and
    stay or go together. Columns keep their names, whatever they are called.
    """
    groups = jaccard_components(docs, id_col, text_col, **how)
    key = unused_name(docs, "loser")
    losers = groups.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(key)).distinct()
    return docs.join(losers, docs[id_col] == losers[key], "left_anti")
