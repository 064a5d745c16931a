"""Benchmark decontamination: near copies of benchmark items inside documents.

Texts and items become sequences of words (A-Z lower-cased, ASCII punctuation
dropped). Every window of an item's own length is a possible near copy; one
with at most ``floor(rate * words)`` word edits is a match.

* A window can only match if all but that many of its words, and all but three
  times that many of its word triples, occur in some item. Running counts over
  the batch drop the other windows; none that matches is lost.
* The windows left are embedded by CGK random walks (Chakraborty, Goldenberg,
  Koucky, 2016): one symbol is put out per step, and a random bit that depends
  on step and symbol decides whether to go on to the next word, so that few
  edits become few Hamming differences.
* Bit sampling: each band takes a few positions of the embedding; windows and
  items that agree there are candidates. ``WALKS`` walks times ``BANDS`` bands
  bring the recall at the largest number of edits to the target (measured in
  the tests).
* Walks drift apart with length, so that items of ``LONG`` words or more go
  another way: a match shares at least words - 2 - 3 * edits word triples with
  its own item, and every window that does is a candidate. None is lost.
* Items of less than ``SHORT`` words allow no edit: every sequence of as many
  words is looked up among them.
* Candidates are verified by the exact edit distance.

Items go to the workers in blocks of at most ``ITEM_WORDS`` words: the size of
what is broadcast is bounded, and each block is run against all documents.
Documents are not shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words
from .stage import unused_name

WALKS, BANDS, SAMPLES = 4, 6, 2
SYMBOLS = 4096
#: Words of the items in one broadcast block: 8 bytes each and as much again for the index.
ITEM_WORDS = 2_000_000
WINDOW_BLOCK = 1 << 15
SHORT = 5
#: Words from which an item's candidates come from shared triples, if a match must share ``LEAST_SHARED`` of them.
LONG, LEAST_SHARED = 60, 8

_rng = np.random.default_rng(7)
_SAMPLED = _rng.random((WALKS, BANDS * SAMPLES))
_PAD = 0
#: Odd multipliers for the length, the samples of a band and the end.
_KEY = _rng.integers(1 << 40, 1 << 62, SAMPLES + 2, dtype=np.uint64) | np.uint64(1)


def _walk_bits(steps: int, walk: int) -> np.ndarray:
    return np.random.default_rng(1000 + walk).integers(0, 2, (steps, SYMBOLS), dtype=np.int8)


def embed(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, walk: int) -> np.ndarray:
    """(BANDS, windows) band keys of the windows ``symbols[start:start+length]`` in one walk.

    Windows with one start share their walk; past its end a window puts out padding.
    """
    first, own = np.unique(start, return_inverse=True)
    steps = int(2 * length.max())
    put = np.zeros((steps, len(first)), np.int64)  # the symbol, and above it the place it was read at
    at = np.zeros(len(first), np.int64)
    bits = _walk_bits(steps, walk)
    last = len(symbols) - 1
    for t in range(steps):
        s = symbols[np.minimum(first + at, last)]
        put[t] = s | at << 32
        at += bits[t, s & (SYMBOLS - 1)]
    flat, columns = put.ravel(), len(first)
    end = length << 32
    reach = 1.8 * length
    base = length.astype(np.uint64) * _KEY[0]
    keys = np.empty((BANDS, len(start)), np.uint64)
    for band in range(BANDS):
        h = base + np.uint64(band)
        for k in range(SAMPLES):
            seen = flat[(_SAMPLED[walk, band * SAMPLES + k] * reach).astype(np.int64) * columns + own]
            seen[seen >= end] = _PAD
            h += (seen & 0xFFFFFFFF).astype(np.uint64) * _KEY[k + 1]
        keys[band] = h * _KEY[-1]
    return keys


def edit_distances(symbols: np.ndarray, start: np.ndarray, items: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    """Edit distances of windows to items of the same length, all windows of one length at once."""
    out = np.zeros(len(start), np.int64)
    lengths = np.array([len(items[w]) for w in which])
    for n in np.unique(lengths):
        for rows in np.array_split(np.flatnonzero(lengths == n), max(1, int((lengths == n).sum() * n) // 4_000_000 + 1)):
            x = symbols[start[rows][:, None] + np.arange(n)]
            y = np.stack([items[w] for w in which[rows]])
            ramp = np.arange(n + 1)
            row = np.tile(ramp, (len(rows), 1))
            for i in range(n):
                step = np.empty_like(row)
                step[:, 0] = i + 1
                step[:, 1:] = np.minimum(row[:, :-1] + (x[:, i : i + 1] != y), row[:, 1:] + 1)
                row = np.minimum.accumulate(step - ramp, axis=1) + ramp
            out[rows] = row[:, -1]
    return out


class ItemIndex:
    """Band tables of one block of items."""

    def __init__(self, ids, hashes: list[np.ndarray], rate: float):
        self.ids = ids
        self.vocab = np.unique(np.concatenate(hashes))
        self.items = [self.symbols(h) for h in hashes]
        length = np.array([len(h) for h in hashes])
        self.edits = np.floor(rate * length + 1e-9).astype(np.int64)
        short = (length < SHORT) & (self.edits == 0) | (length < 3)
        self.edits[short] = 0
        self.short = {}
        for n in np.unique(length[short]):
            own = np.flatnonzero(short & (length == n))
            keys = self.sequence(np.concatenate([self.items[i] for i in own]), np.arange(len(own)) * n, int(n))
            order = np.argsort(keys, kind="stable")
            self.short[int(n)] = keys[order], own[order]
        self.lengths = np.unique(length[~short])
        of_items = [self.triple(self.items[i], np.arange(length[i] - 2)) for i in np.flatnonzero(~short)]
        self.triples = np.unique(np.concatenate(of_items)) if of_items else np.zeros(0, np.uint64)
        self.slack = {int(n): int(np.floor(rate * n + 1e-9)) for n in self.lengths}
        long = (length >= LONG) & (length - 2 - 3 * self.edits >= LEAST_SHARED)
        self.long_lengths = np.unique(length[long])
        walked = np.flatnonzero(~long & ~short)
        self.tables = []
        if len(walked):
            flat = np.concatenate([self.items[i] for i in walked])
            start = np.concatenate(([0], np.cumsum(length[walked])[:-1]))
            for walk in range(WALKS):
                keys = embed(flat, start, length[walked], walk)
                for band in range(BANDS):
                    order = np.argsort(keys[band], kind="stable")
                    self.tables.append((keys[band][order], walked[order]))
        own = [np.unique(self.triple(self.items[i], np.arange(length[i] - 2))) for i in np.flatnonzero(long)]
        keys = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.long_triples = keys[order]
        self.long_items = np.repeat(np.flatnonzero(long), [len(x) for x in own])[order]
        seen = np.zeros(1 << 16, bool)
        seen[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.seen = seen

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the items' vocabulary from 1; other words are 0."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0).astype(np.int64)

    @staticmethod
    def sequence(symbols: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = words.mix(h ^ symbols[at + k].astype(np.uint64) * _KEY[0])
        return h

    @staticmethod
    def triple(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = words.mix(symbols[at].astype(np.uint64) + np.uint64(1 << 40))
        h = words.mix(h ^ symbols[at + 1].astype(np.uint64))
        return words.mix(h ^ symbols[at + 2].astype(np.uint64))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        out[maybe] = self.symbols(h[maybe])
        return out

    def windows(self, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows inside one text that can match some item.

        An edit changes one word and three word triples, so that a match of n
        words with e edits has n - e words and n - 2 - 3e triples of the items.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(symbols) < 3 or not len(self.lengths):
            return none
        known = symbols > 0
        cum_words = np.concatenate(([0], np.cumsum(known)))
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        at = at[np.isin(self.triple(symbols, at), self.triples)]
        hit = np.zeros(len(symbols), np.int64)
        hit[at] = 1
        cum_triples = np.concatenate(([0], np.cumsum(hit)))
        needed = {int(n): int(n) - 2 - 3 * self.slack[int(n)] for n in self.lengths}
        least, longest = min(needed.values()), int(self.lengths[-1])
        if least > 0:
            # only starts with ``least`` triples within reach of the longest window
            if len(at) < least:
                return none
            i = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= longest - 3)
            mark = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(mark, np.maximum(at[i + least - 1] - longest + 3, 0), 1)
            np.add.at(mark, at[i] + 1, -1)
            near = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        else:
            near = np.arange(len(symbols))
        starts, lengths = [], []
        for n in map(int, self.lengths):
            s = near[: np.searchsorted(near, len(symbols) - n, side="right")]
            s = s[(cum_triples[s + max(n - 2, 0)] - cum_triples[s] >= needed[n]) & (cum_words[s + n] - cum_words[s] >= n - self.slack[n])]
            s = s[doc[s] == doc[s + n - 1]]
            starts.append(s)
            lengths.append(np.full(len(s), n))
        return np.concatenate(starts), np.concatenate(lengths)

    def matches(self, symbols: np.ndarray, doc: np.ndarray):
        """(start, item position, edits) of every window that matches and was found by the bands.

        Of long items, those that can be the best of their document.
        """
        yield from self.short_matches(symbols, doc)
        start, length = self.windows(symbols, doc)
        long = np.isin(length, self.long_lengths)
        if long.any():
            yield from self.long_matches(symbols, doc, start[long], length[long])
            start, length = start[~long], length[~long]
        for a in range(0, len(start), WINDOW_BLOCK):
            s, n = start[a : a + WINDOW_BLOCK], length[a : a + WINDOW_BLOCK]
            found = []
            for walk in range(WALKS):
                keys = embed(symbols, s, n, walk)
                for band in range(BANDS):
                    table, order = self.tables[walk * BANDS + band]
                    low = np.searchsorted(table, keys[band], "left")
                    w = np.flatnonzero(table[np.minimum(low, len(table) - 1)] == keys[band])
                    if len(w):
                        low = low[w]
                        count = np.searchsorted(table, keys[band][w], "right") - low
                        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                        found.append(np.repeat(w, count) * len(self.items) + order[np.repeat(low, count) + step])
            if not found:
                continue
            pair = np.unique(np.concatenate(found))
            w, item = pair // len(self.items), pair % len(self.items)
            same = np.array([len(self.items[i]) for i in item]) == n[w]
            w, item = w[same], item[same]
            if len(w):
                d = edit_distances(symbols, s[w], self.items, item)
                ok = d <= self.edits[item]
                yield s[w][ok], item[ok], d[ok]

    def short_matches(self, symbols: np.ndarray, doc: np.ndarray):
        """Places where an item without edits stands as it is; of each document and item the first."""
        for n, (table, order) in self.short.items():
            at = np.flatnonzero(symbols[: len(symbols) - n + 1] > 0)
            if not len(at):
                continue
            at = at[doc[at] == doc[at + n - 1]]
            key = self.sequence(symbols, at, n)
            low = np.searchsorted(table, key, "left")
            hit = np.flatnonzero(table[np.minimum(low, len(table) - 1)] == key)
            at, low = at[hit], low[hit]
            count = np.searchsorted(table, key[hit], "right") - low
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at, item = np.repeat(at, count), order[np.repeat(low, count) + step]
            same = np.ones(len(at), bool)
            for k in range(n):
                same &= symbols[at + k] == np.array([self.items[i][k] for i in item], np.int64)
            at, item = at[same], item[same]
            _, first = np.unique(doc[at] * len(self.items) + item, return_index=True)
            yield at[first], item[first], np.zeros(len(first), np.int64)

    def long_matches(self, symbols: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Matches of long items among their windows, which are counted by the triples of each item."""
        inside = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, start + length - 2, -1)
        at = np.flatnonzero(np.cumsum(inside) > 0)
        key = self.triple(symbols, at)
        low = np.searchsorted(self.long_triples, key, "left")
        count = np.searchsorted(self.long_triples, key, "right") - low
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.long_items[np.repeat(low, count) + step]
        order = np.argsort(item, kind="stable")  # places stay in order
        item, at = item[order], np.repeat(at, count)[order]
        firsts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else []
        for a, b in zip(firsts, [*firsts[1:], len(item)], strict=True):
            g, place = int(item[a]), at[a:b]
            n, most = len(self.items[g]), int(self.edits[g])
            s = start[length == n]
            shared = np.searchsorted(place, s + n - 2) - np.searchsorted(place, s)
            enough = shared >= n - 2 - 3 * most
            s, least = s[enough], -(-(n - 2 - shared[enough]) // 3)  # no window has fewer edits than that
            for d in np.unique(doc[s]):
                own = doc[s] == d
                t, bound = s[own], least[own]
                first = t[[np.argmin(bound)]]
                limit = min(most, int(edit_distances(symbols, first, self.items, np.array([g]))[0]))
                t = t[bound <= limit]
                edits = edit_distances(symbols, t, self.items, np.full(len(t), g))
                ok = edits <= most
                yield t[ok], np.full(int(ok.sum()), g), edits[ok]


def _normal_words(column: pa.Array, limit: int = words.CHUNK_BYTES):
    return words.word_chunks(column, lower=True, strip_punct=True, limit=limit)


def _search(index_of, item_kind: pa.DataType):
    names = ["doc", "item", "word_start", "n_words", "edits"]

    def run(batches):
        index: ItemIndex = index_of()
        for batch in batches:
            hashes, docs, firsts = [], [], []
            for chunk in _normal_words(batch.column(1)):
                hashes.append(index.lookup(chunk.hash))
                docs.append(chunk.doc + chunk.first)
                firsts.append(chunk.bounds[:-1] + sum(len(h) for h in hashes[:-1]))
            if not hashes:
                continue
            symbols, doc, first = np.concatenate(hashes), np.concatenate(docs), np.concatenate(firsts)
            found = list(index.matches(symbols, doc))
            if not found:
                continue
            start, item, d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, d, item, doc[start]))
            start, item, d = start[order], item[order], d[order]
            best = np.ones(len(start), bool)
            best[1:] = (doc[start][1:] != doc[start][:-1]) | (item[1:] != item[:-1])
            start, item, d = start[best], item[best], d[best]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc[start])),
                    pa.array([index.ids[k] for k in item], item_kind),
                    pa.array(start - first[doc[start]]),
                    pa.array(np.array([len(index.items[i]) for i in item], np.int64)),
                    pa.array(d),
                ],
                names=names,
            )

    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str):
    """Word hashes of the items, in blocks of bounded size that are read one after the other."""
    def run(batches):
        for batch in batches:
            for chunk in _normal_words(batch.column(1)):
                bounds = chunk.bounds
                ids = batch.column(0).slice(chunk.first, chunk.n_docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array([chunk.hash[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["item", "h"])

    base = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("x")).where("item IS NOT NULL")
    hashed = base.mapInArrow(run, T.StructType([base.schema["item"], T.StructField("h", T.BinaryType())]))
    hashed = hashed.where(F.length("h") > 0).dropDuplicates(["item", "h"])
    total = hashed.agg(F.sum(F.length("h") / 8)).first()[0] or 0
    n = max(1, int(-(-2 * total // ITEM_WORDS)))
    for k in range(n if total else 0):
        rows = hashed.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).orderBy("item", "h").collect()
        if rows:
            yield [r.item for r in rows], [np.frombuffer(r.h, np.uint64) for r in rows]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    rate: float = 0.2,
) -> DataFrame:
    """Rows (id, item, word_start, n_words, edits, similarity): the best window of each item in each document.

    A match is a window of as many words as the item, inside one document, with
    at most ``floor(rate * words)`` word insertions, deletions or substitutions;
    ties in edits go to the first window. Items without words or with null ids
    are not searched; null and empty documents have no matches. Ids can be of
    any type. Repeated documents give repeated rows; repeated items one each.
    Other columns are ignored, whatever their names. Empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("x"))
    kind = T.StructType([base.schema["doc"], T.StructField("item", items.schema[item_col].dataType)])
    kind = kind.add("word_start", "long").add("n_words", "long").add("edits", "long")
    parts = []
    for block in _item_blocks(items, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)
        parts.append(base.mapInArrow(_search(lambda sent=sent: ItemIndex(*sent.value, rate), to_arrow_schema(kind).field("item").type), kind))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], kind)
    return found.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        "word_start",
        "n_words",
        "edits",
        (1 - F.col("edits") / F.col("n_words")).alias("similarity"),
    )


def drop_leaking(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a near copy of an item; rows with a null id or text are kept.

    Rows with the id of such a document go with it. Columns keep their names
    and order, whatever they are called; repeated rows stay repeated.
    """
    key = unused_name(docs, "leak")
    bad = find_leaks(docs, items, id_col, text_col, **how).select(F.col(id_col).alias(key)).distinct()
    return docs.join(bad, docs[id_col] == bad[key], "left_anti")
