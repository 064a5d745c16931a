"""MinHash near-duplicates with circulant permutations.

Shingles have places in a ring of 2^32. Two permutations of the ring make the
whole signature: ``sigma`` spreads the places, and ``pi``, shifted by k, gives
coordinate k as the least pi(sigma(place) + k) of the set. Bands of coordinates
are keys; sets that share one are a group, and ``set_groups`` finds its links,
with all coordinates as the search within a group and full sets as the proof.
"""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import set_groups, sigtree, words
from .stage import Scratch

#: Coordinates of a band, and the probability that a pair at the threshold shares no band, or falls under the least likeness of a search.
ROWS, MISS = 4, 1e-8
PIECE = 1 << 15


def bands_for(percent: int) -> int:
    share = (percent / 100) ** ROWS
    return 1 if share >= 1 else ceil(log(MISS) / log(1 - share))


def least_matches(coordinates: int, percent: int) -> int:
    """Most matches that a pair at the threshold falls short of with a probability of ``MISS`` at most."""
    t, tail = percent / 100, 0.0
    for k in range(coordinates + 1):
        tail += comb(coordinates, k) * t**k * (1 - t) ** (coordinates - k)
        if tail > MISS:
            return k
    return coordinates


def _permute(x: np.ndarray, spare: np.ndarray, a: int, b: int) -> None:
    """A permutation of the ring, in place: shifts and odd factors can be undone."""
    for shift, factor in ((16, a), (15, b), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def places(hashes: np.ndarray) -> np.ndarray:
    """sigma of the shingles' places."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    _permute(x, np.empty_like(x), 0x21F0AAAD, 0x735A2D97)
    return x


def signatures(hashes: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """(coordinates, sets) minima of non-empty sets given as concatenated hashes."""
    out = np.empty((coordinates, len(bounds) - 1), np.uint32)
    for a, b in words.pieces(bounds, PIECE):
        at = places(hashes[bounds[a] : bounds[b]])
        cuts = bounds[a:b] - bounds[a]
        x, spare = np.empty_like(at), np.empty_like(at)
        for k in range(coordinates):
            np.add(at, np.uint32(k), out=x)
            _permute(x, spare, 0x7FEB352D, 0x846CA68B)
            out[k, a:b] = np.minimum.reduceat(x, cuts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(sets, bands) keys: a hash of each band's coordinates and number."""
    bands = len(minima) // ROWS
    keys = np.empty((minima.shape[1], bands), np.uint64)
    for band in range(bands):
        h = np.full(minima.shape[1], band + 1, np.uint64)
        for row in minima[band * ROWS : (band + 1) * ROWS]:
            h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, band] = h
    return keys


def _signed(width: int, bands: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, hashes, bounds in set_groups.shingle_sets(batch.column(1), width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                minima = signatures(hashes, np.concatenate((bounds[full], bounds[-1:])), ROWS * bands)
                fps, payload = [None] * len(sizes), [None] * len(sizes)
                low = np.ascontiguousarray(minima.astype(np.uint8).T)
                for k, d in enumerate(full):
                    fps[d] = set_groups.fingerprint(hashes[bounds[d] : bounds[d + 1]])
                    payload[d] = low[k].tobytes() + sigtree.bitmap(hashes[bounds[d] : bounds[d + 1]]).tobytes()
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(minima).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sizes)), pa.array(sizes), pa.array(fps, pa.binary()), keys, pa.array(payload, pa.binary())], names=["doc", "n", "fp", "keys", "payload"])

    return run


class SignatureSearch:
    """Pairs by the number of equal coordinates, of which a byte each is kept (chance only adds matches), and by what
    the sizes and a bitmap of the shingles leave possible."""

    def __init__(self, n, payload, comp, percent: int):
        self.n, self.comp, self.percent = n.astype(np.int64), comp, percent
        raw = np.frombuffer(b"".join(payload), np.uint8).reshape(len(n), -1)
        cut = raw.shape[1] - sigtree.BITS // 8
        self.low, self.maps = np.ascontiguousarray(raw[:, :cut]), np.ascontiguousarray(raw[:, cut:]).view(np.uint64)
        self.excess = self.n - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        self.least = least_matches(cut, percent)

    def _may(self, i, j, matches):
        """Places of the pairs that may link."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        at = np.flatnonzero((matches >= self.least) & (self.comp[i] != self.comp[j]) & (small * 100 >= large * self.percent))
        keep = []
        for k in range(0, len(at), set_groups.PAIR_BLOCK):
            own = at[k : k + set_groups.PAIR_BLOCK]
            a, b = i[own], j[own]
            most = np.bitwise_count(self.maps[a] & self.maps[b]).sum(axis=1).astype(np.int64) + np.minimum(self.excess[a], self.excess[b])
            keep.append(own[np.minimum(most, small[own]) * (100 + self.percent) >= self.percent * (self.n[a] + self.n[b])])
        return np.concatenate(keep) if keep else at

    def check(self, i, j):
        matches = (self.low[i] == self.low[j]).sum(axis=1)
        keep = self._may(i, j, matches)
        return keep, matches[keep]

    def across(self, a, b):
        other = a if b is None else b
        step = max(1, (1 << 22) // (max(len(other), 1) * self.low.shape[1]))
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            matches = (self.low[rows][:, None, :] == self.low[other][None, :, :]).sum(axis=2)
            i, j = np.nonzero(matches >= self.least)
            if b is None:
                i, j = i[i + at < j], j[i + at < j]
            keep = self._may(rows[i], other[j], matches[i, j])
            if len(keep):
                yield i[keep] + at, j[keep], matches[i[keep], j[keep]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 2, percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles, component_id, class_size) for every row of ``docs``.

    Two texts link when ``100 * |A & B| >= percent * |A | B|`` of their sets of
    distinct word shingles, which is tested on the full sets. component_id is
    the smallest id reachable by links, class_size the number of rows with the
    very same set. A pair at the threshold is no candidate with a probability of
    ``MISS``; likelier pairs are missed less.

    Null and empty texts, or texts without words: n_shingles 0, linked with
    nothing, component_id their own id. Texts with fewer words than ``width``
    have one shingle, the whole sequence. Rows that repeat an id are rows of
    their own with that id; null ids are kept and never chosen over an id. Very
    long texts are taken whole. Other columns of ``docs`` are ignored, whatever
    their names. An empty table gives an empty result. Intermediate tables stay
    in ``spark.checkpoint.dir``.
    """
    scratch = Scratch(docs.sparkSession, "circulant-minhash")
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("txt"))
    schema = T.StructType([base.schema["doc"], *T.StructType.fromDDL("n long, fp binary, keys array<long>, payload binary").fields])
    rows, classes = set_groups.save_classes(base.mapInArrow(_signed(width, bands_for(percent)), schema), scratch)
    named = set_groups.class_components(classes, base, width, lambda n, payload, comp: SignatureSearch(n, payload, comp, percent), percent, 100, scratch)
    out = set_groups.to_rows(rows, named, scratch)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "class_size")
