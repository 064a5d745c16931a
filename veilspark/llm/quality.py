"""Quality classifier: a conditional random field over the lines of a document.

Every line gets features of its characters and words and of its neighbours;
forward-backward gives its probability of being good, and the mean over lines,
weighted by length, is the document's quality, calibrated to a probability.

Fitting uses at most ``MAX_DOCS`` labelled documents of at most ``MAX_LINES``
lines, those with the smallest hash of the id (documented bounds; scoring
covers all documents and lines). Only line features of the sample reach the
driver. The labels of the lines are latent: see ``crf``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .crf import Crf

#: Inner bin edges: shares of the sample's lines below them, dense at the top, where noise shows.
SHARES = (0.05, 0.2, 0.4, 0.6, 0.8, 0.88, 0.93, 0.96, 0.98, 0.992)
MAX_DOCS, MAX_LINES = 5000, 1000
ROUNDS = 120
#: How much all lines of a document weigh together for its label, for each line that it has.
TIE = 0.5

_LETTER = {name: np.zeros(256, bool) for name in ("upper", "lower", "digit")}
_LETTER["upper"][65:91] = True
_LETTER["lower"][97:123] = True
_LETTER["digit"][48:58] = True
#: Signs that end words of ordinary prose; any other sign at a word's end counts as noise.
_PROSE = np.zeros(256, bool)
_PROSE[[ord(c) for c in ".,;:?\"')"]] = True
N_FEATURES = 13


def line_features(column: pa.Array):
    """Per chunk: first text, (lines, N_FEATURES) values, bytes per line, and line bounds of the texts."""
    for chunk in words.word_chunks(column, lower=False):
        data, off = chunk.data, chunk.offsets
        breaks = np.flatnonzero(data == 10)
        start = np.sort(np.concatenate((off[:-1], breaks + 1)), kind="stable")
        # a break that ends one text and the next text's start give equal offsets; both are lines
        per_doc = np.diff(np.searchsorted(breaks, off)) + 1
        bounds = np.concatenate(([0], np.cumsum(per_doc)))
        end = np.empty(len(start), np.int64)
        end[:-1] = start[1:] - 1
        end[bounds[1:] - 1] = off[1:]
        size = np.maximum(end - start, 0)

        def count(places, start=start, end=end):
            return np.searchsorted(places, end) - np.searchsorted(places, start)

        def of(mask, data=data):
            return count(np.flatnonzero(mask[data]))

        upper, lower, digit, punct = of(_LETTER["upper"]), of(_LETTER["lower"]), of(_LETTER["digit"]), of(words.IS_PUNCT)
        pipe, stop, wide = count(np.flatnonzero(data == 124)), count(np.flatnonzero(data == 46)), count(np.flatnonzero(data >= 0xC0))
        w0, h = chunk.start, chunk.hash
        first = np.searchsorted(w0, start)
        n_words = np.searchsorted(w0, end) - first
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        last = data[chunk.end - 1] if len(h) else np.zeros(0, np.uint8)
        noisy = words.IS_PUNCT[last] & ~_PROSE[last]
        capital = _LETTER["upper"][data[w0]] if len(h) else np.zeros(0, bool)
        seen = _seen_before(chunk)

        def per_word(mask, first=first, n_words=n_words):
            c = np.concatenate(([0], np.cumsum(mask)))
            return (c[first + n_words] - c[first]) / np.maximum(n_words, 1)

        lengths = np.concatenate(([0], np.cumsum(chunk.end - chunk.start)))
        x = np.stack(
            [
                np.log2(1.0 + size),
                upper / (upper + lower + 1.0),
                digit / (size + 1.0),
                punct / (size + 1.0),
                pipe / np.maximum(n_words, 1),
                per_word(again),
                (lengths[first + n_words] - lengths[first]) / np.maximum(n_words, 1),
                per_word(noisy),
                per_word(seen),
                per_word(capital),
                wide / (size + 1.0),
                stop / np.maximum(n_words, 1),
                np.log2(1.0 + n_words),
            ],
            axis=1,
        )
        yield chunk.first, x, size, bounds


def _seen_before(chunk: words.Chunk) -> np.ndarray:
    """Words at which a three-word sequence starts that the same text has had before."""
    out = np.zeros(len(chunk.hash), bool)
    hashes, bounds = words.shingle_hashes(chunk, 3)
    for d in range(chunk.n_docs):
        a, b = bounds[d], bounds[d + 1]
        if b - a > 1:
            first = np.unique(hashes[a:b], return_index=True)[1]
            if len(first) < b - a:
                flag = np.ones(b - a, bool)
                flag[first] = False
                out[chunk.bounds[d] : chunk.bounds[d] + b - a] = flag
    return out


@dataclass
class QualityModel:
    crf: Crf | None
    scale: float
    shift: float
    prior: float

    def score(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and P(good) of each line."""
        if self.crf is None:
            return np.full(len(bounds) - 1, self.prior), np.full(len(x), self.prior)
        good = self.crf.marginals(self.crf.odds(self.crf.codes(x, bounds)), bounds)
        return _sigmoid(self.scale * _logit(_weighted(good, size, bounds)) + self.shift), good


def _weighted(good, size, bounds):
    weight = size + 1.0
    total = np.add.reduceat(weight, bounds[:-1]) if len(weight) else np.zeros(0)
    return np.add.reduceat(good * weight, bounds[:-1]) / total if len(weight) else np.zeros(0)


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def ties(size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The weight of each line for its document's label: its share of the length, times the number of lines."""
    lines = np.diff(bounds)
    weight = size + 1.0
    return TIE * weight * np.repeat(lines / np.add.reduceat(weight, bounds[:-1]), lines)


def fit_lines(x: np.ndarray, size: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> QualityModel:
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return QualityModel(None, 1.0, 0.0, float(prior))
    edges = np.stack([_edges(x[:, k]) for k in range(x.shape[1])])
    crf = Crf(edges)
    codes = crf.codes(x, bounds)
    crf.fit(codes, labels, bounds, ties(size, bounds), rounds=ROUNDS)
    g = _logit(_weighted(crf.marginals(crf.odds(codes), bounds), size, bounds))
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one variable
        p = _sigmoid(scale * g + shift)
        w = p * (1 - p) + 1e-6
        gap = labels - p
        hess = np.array([[(w * g * g).sum() + 1.0, (w * g).sum()], [(w * g).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(gap * g).sum() - (scale - 1), gap.sum()])
        scale, shift = scale + step[0], shift + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return QualityModel(crf, float(scale), float(shift), float(prior))


def _edges(values: np.ndarray) -> np.ndarray:
    """Inner bin edges at quantiles of the values; repeated quantiles leave empty bins."""
    return np.quantile(values, SHARES, method="higher")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 1 with any number of folds over 1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(1).cast("long"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    *,
    folds: int = 5,
    held_out: int = 0,
    max_docs: int = MAX_DOCS,
    max_lines: int = MAX_LINES,
) -> QualityModel:
    """Model from at most ``max_docs`` labelled documents outside the held-out fold, without those of over ``max_lines`` lines.

    Rows with a null id or label are ignored; repeated labels of an id count as
    their largest. Without labels of both kinds the model gives every text the
    share of good labels.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("i"), "i").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("x"))
    chosen = texts.join(F.broadcast(sample), "i").select("y", "x")
    schema = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("v", pa.binary()), ("s", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, x, size, bounds in line_features(batch.column(1)):
                short = np.flatnonzero(np.diff(bounds) <= max_lines)
                values = [x[bounds[k] : bounds[k + 1]].astype(np.float32).tobytes() for k in short]
                sizes = [size[bounds[k] : bounds[k + 1]].tobytes() for k in short]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + short)), pa.array(np.diff(bounds)[short]), pa.array(values, pa.binary()), pa.array(sizes, pa.binary())],
                    schema=schema,
                )

    rows = chosen.mapInArrow(run, "y int, n long, v binary, s binary").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.v)))
    if not rows:
        return QualityModel(None, 1.0, 0.0, 0.5)
    x = np.concatenate([np.frombuffer(r.v, np.float32) for r in rows]).reshape(-1, N_FEATURES).astype(float)
    size = np.concatenate([np.frombuffer(r.s, np.int64) for r in rows])
    bounds = np.concatenate(([0], np.cumsum([r.n for r in rows])))
    return fit_lines(x, size, bounds, np.array([r.y > 0 for r in rows]).astype(int))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, n_lines, n_good_lines), one for each row of ``docs``.

    Null and empty texts are one empty line and get its score. Repeated rows
    are scored each; other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("x"))

    def run(batches):
        own = sent.value
        for batch in batches:
            for first, x, size, bounds in line_features(batch.column(1)):
                value, good = own.score(x, size, bounds)
                n_good = np.add.reduceat((good >= 0.5).astype(np.int64), bounds[:-1]) if len(good) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(value)), pa.array(value), pa.array(np.diff(bounds)), pa.array(n_good)], names=["i", "score", "n_lines", "n_good_lines"])

    out = base.mapInArrow(run, base.select("i").schema.add("score", "double").add("n_lines", "long").add("n_good_lines", "long"))
    return out.withColumnRenamed("i", id_col)


def keep_good(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with their own columns."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            keep = [own.score(x, size, bounds)[0] >= threshold for _, x, size, bounds in line_features(batch.column(at).cast(pa.string()))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
