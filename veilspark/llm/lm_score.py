"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Words and word pairs of the training texts are counted over the whole corpus,
those that occur once as well. A count c is kept as its level ``1 + floor(log_BASE c)``:
the filter gets the n-gram with each level up to its own, so that probing
levels until one misses gives the level back, and the middle of the level's
counts, written q(c), stands for the count.

P(w | v) = (1 - B(v)) * q(v, w) / Q(v) + B(v) * (q(w) + 1) / Z

Q(v) is the sum of q(v, w) over the words seen after v, and B(v) the
Witten-Bell share T(v) / (Q(v) + T(v)) of new words, T(v) being the number of
distinct ones. Q in steps of 1 % and B in steps of 1/16 are in the filter too,
as the digits of one number, found by membership probes. So the probabilities
after a word v add up to 1, whatever the levels round off; Z makes those of
single words do, with one unknown word. After an unknown v the single word's
probability is the whole.

A word that does not follow v must not seem to: the first level of a pair is
probed ``SAFETY + log2(vocabulary)`` times, so that all false followers of v
together are under 1 / 2**SAFETY pairs on average, at every size of the corpus.

The filter is cut into blocks by hash range, built in parallel. Pairs go to the
range of their first word; those of the most frequent words (``HOT_SHARE`` of
all tokens and more, so at most 1 / HOT_SHARE words) are dealt by the pair, and
their sums are put together afterwards. A filter of at most ``MAX_FILTER_BYTES``
is sent to the workers. A larger one never leaves the tasks that build its
blocks: the distinct n-grams of each batch of texts go to their range once,
with their counts in the training texts; the range adds the counts, builds its
block, and sends what the block says back to the batches. Both ways probe the
same bits and give the same scores.

Words counted for the base score are exact: the ``HOT_WORDS`` most frequent
ones go to the workers as a sorted table and all others by a join on the word,
or the ranges send the counts back with the levels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from . import words
from .stage import Scratch

BASE, MAX_LEVEL = 1.5, 64
#: Probes of a level, of a digit, and those of a pair's first level beyond log2 of the vocabulary.
LEVEL_PROBES, DIGIT_PROBES, SAFETY = 12, 20, 12
#: Steps of Q(v), their digits, and digits of B(v).
FINE, SUM_DIGITS, SHARE_DIGITS = 1.01, 12, 4
#: The most bytes of the filter that are sent to a worker.
MAX_FILTER_BYTES = 64 << 20
#: Share of all tokens from which a word's pairs are dealt by the pair.
HOT_SHARE = 1 / 512
#: Texts, in bytes, whose n-grams go to their ranges together where the filter is not sent, and n-grams probed at once.
ASK_BYTES, PROBE_BLOCK = 8 << 20, 1 << 20
HOT_WORDS = 1 << 20
FLUSH_TOKENS = 1 << 21

END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xD6E8FEB86659FD93)
_WORDS, _PAIRS, _SUMS = 0, 1, 2


_INT, _LONG, _DOUBLE, _BYTES = pa.int32(), pa.int64(), pa.float64(), pa.binary()
_WORD_COLUMNS = {"bucket": _INT, "word": _LONG, "n": _LONG, "packed": _BYTES, "levels": _BYTES, "probes": _LONG, "mass": _DOUBLE}
_PAIR_COLUMNS = {
    "bucket": _INT, "hot": _LONG, "total": _DOUBLE, "followers": _LONG, "packed": _BYTES, "levels": _BYTES, "firsts": _LONG, "probes": _LONG,
    "sum_packed": _BYTES, "sum_numbers": _BYTES, "sum_probes": _LONG,
}
_WORD_ANSWERS = {"batch": _LONG, "bucket": _INT, "levels": _BYTES, "counts": _BYTES, "word": _LONG, "n": _LONG, "words": _LONG, "tokens": _LONG, "mass": _DOUBLE}
_PAIR_ANSWERS = {"batch": _LONG, "bucket": _INT, "levels": _BYTES, "numbers": _BYTES, "hot": _LONG, "total": _DOUBLE, "followers": _LONG}


def _rows(kinds: dict[str, pa.DataType], columns: dict, n: int) -> pa.Table:
    """``n`` rows of a table with these columns; those not given are null."""
    return pa.table({name: pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in kinds.items()})


def _schema(kinds: dict[str, pa.DataType]) -> T.StructType:
    return from_arrow_schema(pa.schema(list(kinds.items())))


def _pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return words.mix(v * _C ^ words.mix(w + _D))


def _sequences(column: pa.Array, limit: int = words.CHUNK_BYTES):
    """Per chunk: words with an end after each text, their predecessors, and bounds of the texts."""
    for chunk in words.word_chunks(column, limit=limit):
        counts = np.diff(chunk.bounds) + 1
        bounds = np.concatenate(([0], np.cumsum(counts)))
        w = np.empty(bounds[-1], np.uint64)
        w[np.arange(len(chunk.hash)) + chunk.doc] = chunk.hash
        w[bounds[1:] - 1] = END
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[bounds[:-1]] = START
        yield chunk, w, v, bounds


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash range of each hash; ``buckets`` is a power of two."""
    return (h >> np.uint64(64 - int(math.log2(buckets)))).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)


def _pair_bucket(v: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(np.where(np.isin(v, hot), pair, v) if len(hot) else v, buckets)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _flushed(take, schema: pa.Schema):
    """Tokens of a partition in lots of ``FLUSH_TOKENS``, each turned to rows by ``take(w, v)``."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, w, v, _ in _sequences(batch.column(0)):
                held.append((w, v))
                n += len(w)
                if n >= FLUSH_TOKENS:
                    yield from pa.Table.from_pylist(list(take(*map(np.concatenate, zip(*held, strict=True)))), schema).to_batches()
                    held, n = [], 0
        if held:
            yield from pa.Table.from_pylist(list(take(*map(np.concatenate, zip(*held, strict=True)))), schema).to_batches()

    return run


def _count_words(buckets: int):
    def take(w, v):
        h, c = np.unique(w, return_counts=True)
        edge = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            x, y = edge[b], edge[b + 1]
            yield {"bucket": int(b), "h": h[x:y].tobytes(), "c": c[x:y].astype(np.uint32).tobytes()}

    return _flushed(take, pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])), "bucket int, h binary, c binary"


def _count_pairs(buckets: int, hot: np.ndarray):
    def take(w, v):
        h, first, c = np.unique(_pairs(v, w), return_index=True, return_counts=True)
        own = v[first]
        bucket = _pair_bucket(own, h, hot, buckets)
        order = np.lexsort((own, bucket))
        h, own, c, bucket = h[order], own[order], c[order].astype(np.uint32), bucket[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            x, y = edge[b], edge[b + 1]
            starts = _runs(own[x:y])
            followers = np.diff(np.append(starts, y - x)).astype(np.uint32)
            yield {"bucket": int(b), "v": own[x:y][starts].tobytes(), "followers": followers.tobytes(), "h": h[x:y].tobytes(), "c": c[x:y].tobytes()}

    schema = pa.schema([("bucket", pa.int32()), *[(name, pa.binary()) for name in ("v", "followers", "h", "c")]])
    return _flushed(take, schema), "bucket int, v binary, followers binary, h binary, c binary"


def levels_of(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(c) / math.log(BASE) + 1e-9).astype(np.int64)


#: Middle of the count range of each level.
_MIDDLE = np.concatenate(([0.0], [(max(1.0, BASE ** (j - 1)) + max(1.0, BASE**j)) / 2 if j > 2 else float(j) for j in range(1, MAX_LEVEL)]))


def _summed(h: np.ndarray, c: np.ndarray, *more: np.ndarray):
    """Distinct hashes in order, their summed counts, and the first of each further column."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = _runs(h)
    return h[first], np.add.reduceat(c[order], first), *[m[order][first] for m in more]


def _gather_words(table: pa.Table) -> pa.Table:
    """All counts of one hash range: words as rows, and one row with the range's part of the filter."""
    h, c = _summed(
        np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]),
        np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("c").to_pylist()]).astype(np.int64),
    )
    level, bucket = levels_of(c), table.column("bucket")[0].as_py()
    head = {"packed": [h.tobytes()], "levels": [level.astype(np.uint8).tobytes()], "probes": [int(level.sum()) * LEVEL_PROBES], "mass": [float((_MIDDLE[level] + 1).sum())]}
    rows = {"bucket": [bucket] * len(h), "word": h.view(np.int64), "n": c}
    return pa.concat_tables([_rows(_WORD_COLUMNS, {"bucket": [bucket], **head}, 1), _rows(_WORD_COLUMNS, rows, len(h))])


def encode(total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The number whose digits keep Q(v) and B(v)."""
    fine = np.minimum(np.rint(np.log(total) / math.log(FINE)).astype(np.int64), (1 << SUM_DIGITS) - 1)
    share = np.minimum((distinct / (total + distinct) * (1 << SHARE_DIGITS)).astype(np.int64), (1 << SHARE_DIGITS) - 1)
    return fine | share << SUM_DIGITS


def decode(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q(v) and B(v)."""
    number = number.astype(np.int64)
    return FINE ** (number & ((1 << SUM_DIGITS) - 1)), ((number >> SUM_DIGITS) + 0.5) / (1 << SHARE_DIGITS)


#: The number of a word with one follower, once: most words, which have no digits in the filter.
PLAIN = int(encode(np.ones(1), np.ones(1))[0])
DIGITS = SUM_DIGITS + SHARE_DIGITS


def _range_parts(h: np.ndarray, v: np.ndarray, c: np.ndarray, hot: np.ndarray):
    """Of the pairs of one range: hashes and levels; first words that are not hot, their numbers and probes; sums of hot words."""
    level = levels_of(c) if len(c) else np.zeros(0, np.int64)
    own, at, distinct = np.unique(v, return_inverse=True, return_counts=True)
    total = np.bincount(at, _MIDDLE[level], len(own))
    is_hot = np.isin(own, hot)
    number = encode(total, distinct) if len(own) else np.zeros(0, np.int64)
    kept = ~is_hot & (number != PLAIN)
    probes = int(np.bitwise_count(number[kept].astype(np.uint64)).sum()) * DIGIT_PROBES
    return h, level, (own[kept], number[kept].astype(np.uint16), probes), (own[is_hot], total[is_hot], distinct[is_hot].astype(np.int64))


def _gather_pairs(hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        """One row with the range's part of the filter, and a row of sums for each hot word."""
        blobs = {k: table.column(k).to_pylist() for k in ("v", "followers", "h", "c")}
        followers = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs["followers"]])
        v = np.repeat(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs["v"]]), followers)
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs["c"]]).astype(np.int64)
        h, c, v = _summed(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs["h"]]), c, v)
        h, level, numbers, hots = _range_parts(h, v, c, hot)
        head = {
            "packed": [h.tobytes()], "levels": [level.astype(np.uint8).tobytes()], "firsts": [len(h)], "probes": [int((level - 1).sum()) * LEVEL_PROBES],
            "sum_packed": [numbers[0].tobytes()], "sum_numbers": [numbers[1].tobytes()], "sum_probes": [numbers[2]],
        }
        bucket = table.column("bucket")[0].as_py()
        rows = {"bucket": [bucket] * len(hots[0]), "hot": hots[0].view(np.int64), "total": hots[1], "followers": hots[2]}
        return pa.concat_tables([_rows(_PAIR_COLUMNS, {"bucket": [bucket], **head}, 1), _rows(_PAIR_COLUMNS, rows, len(hots[0]))])

    return run


class Block:
    """The bits of the filter for one kind of n-gram and one hash range.

    ``first`` is the number of probes of an n-gram's first level.
    """

    def __init__(self, size: int, bits: np.ndarray, first: int):
        self.size, self.bits, self.first = np.uint64(size), bits, first

    @staticmethod
    def places(h: np.ndarray, salt, probe: int, size: np.uint64, seeds=None) -> np.ndarray:
        a, b = seeds if seeds is not None else Block.seeds(h, salt)
        return (a + np.uint64(probe) * b + np.uint64((probe**3 - probe) // 6)) % size

    @staticmethod
    def seeds(h: np.ndarray, salt) -> tuple[np.ndarray, np.ndarray]:
        a = words.mix(h + np.asarray(salt).astype(np.uint64) * _C)
        return a >> np.uint64(8), words.mix(a ^ _D) >> np.uint64(8)

    @classmethod
    def build(cls, entries: list[tuple[np.ndarray, np.ndarray | int, int]], probes: int, first: int = LEVEL_PROBES) -> Block:
        """``entries``: hashes, their salts and the number of probes; ``probes``: all of them together."""
        size = max(64, -(-int(probes / math.log(2)) // 64) * 64)
        bits = np.zeros(size, bool)
        for h, salt, times in entries:
            for a in range(0, len(h), PROBE_BLOCK):
                part = h[a : a + PROBE_BLOCK]
                seeds = cls.seeds(part, salt if np.isscalar(salt) else salt[a : a + PROBE_BLOCK])
                for k in range(times):
                    bits[cls.places(part, salt, k, np.uint64(size), seeds)] = True
        return cls(size, np.packbits(bits, bitorder="little"), first)

    def has(self, h: np.ndarray, salt: int, times: int) -> np.ndarray:
        a, b = self.seeds(h, salt)
        alive = np.arange(len(h))
        for k in range(times):
            place = self.places(h, salt, k, self.size, (a, b)).astype(np.int64)
            hit = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            if not hit.all():
                alive, a, b = alive[hit], a[hit], b[hit]
                if not len(alive):
                    break
        out = np.zeros(len(h), bool)
        out[alive] = True
        return out

    def levels(self, h: np.ndarray) -> np.ndarray:
        level, alive = np.zeros(len(h), np.uint8), np.arange(len(h))
        for j in range(1, MAX_LEVEL):
            alive = alive[self.has(h[alive], j, self.first if j == 1 else LEVEL_PROBES)]
            if not len(alive):
                break
            level[alive] = j
        return level

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Digits put together; ``PLAIN`` where there are none."""
        out = np.zeros(len(h), np.uint16)
        for j in range(DIGITS):
            out |= self.has(h, j, DIGIT_PROBES).astype(np.uint16) << np.uint16(j)
        out[out == 0] = PLAIN
        return out


def _build(kind: int, packed: bytes, levels: bytes, probes: int, first: int) -> Block:
    h = np.frombuffer(packed, np.uint64)
    if kind == _SUMS:
        number = np.frombuffer(levels, np.uint16).astype(np.int64)
        return Block.build([(h[number >> j & 1 == 1], j, DIGIT_PROBES) for j in range(DIGITS)], probes)
    level = np.frombuffer(levels, np.uint8)
    entries = [(h, 1, first)] + [(h[level >= j], j, LEVEL_PROBES) for j in range(2, int(level.max(initial=0)) + 1)]
    return Block.build(entries, probes, first)


def _fill(first: int):
    def run(batches):
        for batch in batches:
            kinds, buckets, packed, levels, probes = (batch.column(k).to_pylist() for k in range(5))
            blocks = [_build(k, p, x, n, first if k == _PAIRS else LEVEL_PROBES) for k, p, x, n in zip(kinds, packed, levels, probes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(b.size) for b in blocks], pa.int64()), pa.array([b.bits.tobytes() for b in blocks], pa.binary())], names=["kind", "bucket", "size", "bits"])

    return run, "kind int, bucket int, size long, bits binary"


class LogFrequencyFilter:
    """Levels of words and pairs and numbers of histories, read by repeated membership probes."""

    def __init__(self, buckets: int, hot: np.ndarray, blocks: dict[tuple[int, int], Block]):
        self.buckets, self.hot, self.blocks = buckets, hot, blocks

    def _each(self, kind: int, h: np.ndarray, bucket: np.ndarray, empty: int, read) -> np.ndarray:
        out = np.full(len(h), empty, np.uint16 if kind == _SUMS else np.uint8)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            block = self.blocks.get((kind, int(b)))
            if block is not None:
                at = order[edge[b] : edge[b + 1]]
                out[at] = read(block, h[at])
        return out

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level of each word, and the number of what follows it."""
        bucket = _bucket(h, self.buckets)
        return self._each(_WORDS, h, bucket, 0, Block.levels), self._each(_SUMS, h, bucket, PLAIN, Block.numbers)

    def pairs(self, v: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return self._each(_PAIRS, pair, _pair_bucket(v, pair, self.hot, self.buckets), 0, Block.levels)


class AnsweredLevels:
    """What the hash ranges sent back for one batch of texts."""

    def __init__(self, own: np.ndarray, levels: np.ndarray, pairs: np.ndarray, pair_levels: np.ndarray, histories: np.ndarray, numbers: np.ndarray):
        self.own, self.levels = own, levels
        order = np.argsort(pairs, kind="stable")
        self.pair, self.pair_levels = pairs[order], pair_levels[order]
        order = np.argsort(histories, kind="stable")
        self.histories, self.numbers = np.append(histories[order], ~np.uint64(0)), np.append(numbers[order], np.uint16(PLAIN))

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.searchsorted(self.own, h)
        level = np.where(h == START, 0, self.levels[np.minimum(known, len(self.own) - 1)])
        at = np.searchsorted(self.histories, h)
        return level, np.where(self.histories[at] == h, self.numbers[at], PLAIN)  # a word at a text's end has no followers here

    def pairs(self, v: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return self.pair_levels[np.searchsorted(self.pair, pair)]


def _tokens(docs: pa.RecordBatch):
    """Words of a batch (i, x, scored, trained), their predecessors, and whether they are trained on."""
    parts = []
    for chunk, w, v, bounds in _sequences(docs.column(1)):
        trained = docs.column(3).slice(chunk.first, chunk.n_docs).to_numpy(zero_copy_only=False)
        parts.append((w, v, np.repeat(trained.astype(bool), np.diff(bounds))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _word_lots(w: np.ndarray, trained: np.ndarray, buckets: int):
    """Distinct words in order, their counts in training texts, and the bounds of the hash ranges."""
    h, own = np.unique(w, return_inverse=True)
    return h, np.bincount(own, trained, len(h)).astype(np.uint32), np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))


def _pair_lots(w: np.ndarray, v: np.ndarray, trained: np.ndarray, hot: np.ndarray, buckets: int):
    """Distinct pairs by range and first word: their first words, counts in training texts, and the bounds of the ranges."""
    h, first, own = np.unique(_pairs(v, w), return_index=True, return_inverse=True)
    before = v[first]
    bucket = _pair_bucket(before, h, hot, buckets)
    order = np.lexsort((before, bucket))
    count = np.bincount(own, trained, len(h)).astype(np.uint32)
    return h[order], before[order], count[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _deal(batches):
    """Texts in numbered batches of about ``ASK_BYTES``, one row for each."""
    number, held, size = TaskContext.get().partitionId() << 20, [], 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "docs"])

    for batch in batches:
        offsets = words.utf8(batch.column(1))[1]
        offsets = offsets + np.arange(len(offsets))  # an empty text counts as well
        for a, b in words.pieces(offsets, ASK_BYTES):
            more = int(offsets[b] - offsets[a])
            if held and size + more > ASK_BYTES:
                yield flush()
                number, held, size = number + 1, [], 0
            held.append(pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns], names=batch.schema.names))
            size += more
    if held:
        yield flush()


def _dealt(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _per_batch(rows_of, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from pa.Table.from_pylist([{"batch": number, **row} for row in rows_of(_dealt(blob))], schema).to_batches()

    return run


def _ask_words(buckets: int):
    def rows_of(docs):
        w, _, trained = _tokens(docs)
        h, c, edge = _word_lots(w, trained, buckets)
        return [{"bucket": int(b), "h": h[edge[b] : edge[b + 1]].tobytes(), "c": c[edge[b] : edge[b + 1]].tobytes()} for b in np.flatnonzero(np.diff(edge))]

    return _per_batch(rows_of, pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])), "batch long, bucket int, h binary, c binary"


def _ask_pairs(buckets: int, hot: np.ndarray):
    def rows_of(docs):
        w, v, trained = _tokens(docs)
        h, before, c, edge = _pair_lots(w, v, trained, hot, buckets)
        out = []
        for b in np.flatnonzero(np.diff(edge)):
            x, y = edge[b], edge[b + 1]
            starts = _runs(before[x:y])
            followers = np.diff(np.append(starts, y - x)).astype(np.uint32)
            out.append({"bucket": int(b), "v": before[x:y][starts].tobytes(), "followers": followers.tobytes(), "h": h[x:y].tobytes(), "c": c[x:y].tobytes()})
        return out

    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *[(name, pa.binary()) for name in ("v", "followers", "h", "c")]])
    return _per_batch(rows_of, schema), "batch long, bucket int, v binary, followers binary, h binary, c binary"


def _joined(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """A column of packed arrays as one, and the ends of its rows."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts), np.cumsum([len(x) for x in parts])[:-1]


def _split(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(values, ends)]


def _answer_words(asked: pa.Table) -> pa.Table:
    """Levels and counts of one hash range's words for each batch, the range's sums, and its most frequent words."""
    (h, ends), (c, _) = _joined(asked, "h", np.uint64), _joined(asked, "c", np.uint32)
    distinct, own = np.unique(h, return_inverse=True)
    n = np.bincount(own, c, len(distinct)).astype(np.int64)
    seen, bucket = n > 0, asked.column("bucket")[0].as_py()
    level = levels_of(n[seen])
    block = _build(_WORDS, distinct[seen].tobytes(), level.astype(np.uint8).tobytes(), int(level.sum()) * LEVEL_PROBES, LEVEL_PROBES)
    batches = asked.column("batch").to_pylist()
    answers = {"batch": batches, "bucket": [bucket] * len(batches), "levels": _split(block.levels(distinct)[own], ends), "counts": _split(n[own], ends)}
    often = np.flatnonzero(n >= max(1.0, n.sum() * HOT_SHARE))
    sums = {"bucket": [bucket], "words": [int(seen.sum())], "tokens": [int(n.sum())], "mass": [float((_MIDDLE[level] + 1).sum())]}
    hot = {"bucket": [bucket] * len(often), "word": distinct[often].view(np.int64), "n": n[often]}
    return pa.concat_tables([_rows(_WORD_ANSWERS, answers, len(batches)), _rows(_WORD_ANSWERS, sums, 1), _rows(_WORD_ANSWERS, hot, len(often))])


def _answer_pairs(hot: np.ndarray, first: int):
    def run(asked: pa.Table) -> pa.Table:
        """Levels of one hash range's pairs and numbers of their first words for each batch, and sums of the hot words."""
        (h, ends), (c, _), (v, v_ends), (followers, _) = (_joined(asked, k, t) for k, t in (("h", np.uint64), ("c", np.uint32), ("v", np.uint64), ("followers", np.uint32)))
        distinct, at, own = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(own, c, len(distinct)).astype(np.int64)
        seen = n > 0
        packed, level, numbers, hots = _range_parts(distinct[seen], np.repeat(v, followers)[at[seen]], n[seen], hot)
        block = _build(_PAIRS, packed.tobytes(), level.astype(np.uint8).tobytes(), int((level - 1).sum()) * LEVEL_PROBES + len(level) * first, first)
        sums = _build(_SUMS, numbers[0].tobytes(), numbers[1].tobytes(), numbers[2], LEVEL_PROBES)
        batches, bucket = asked.column("batch").to_pylist(), asked.column("bucket")[0].as_py()
        words_, word = np.unique(v, return_inverse=True)
        answers = {"batch": batches, "bucket": [bucket] * len(batches), "levels": _split(block.levels(distinct)[own], ends), "numbers": _split(sums.numbers(words_)[word], v_ends)}
        extra = {"bucket": [bucket] * len(hots[0]), "hot": hots[0].view(np.int64), "total": hots[1], "followers": hots[2]}
        return pa.concat_tables([_rows(_PAIR_ANSWERS, answers, len(batches)), _rows(_PAIR_ANSWERS, extra, len(hots[0]))])

    return run


def _score_answered(get, schema: pa.Schema):
    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        docs, model = _dealt(dealt.column("docs")[0].as_py()), get()
        w, v, trained = _tokens(docs)
        own, _, _ = _word_lots(w, trained, model["buckets"])
        pair, before, _, edge = _pair_lots(w, v, trained, model["hot"], model["buckets"])
        bucket = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        histories = before[_runs(before, bucket)] if len(before) else before
        answers = answers.sort_by("bucket")
        of_words, of_pairs = answers.filter(pa.compute.is_valid(answers.column("counts"))), answers.filter(pa.compute.is_valid(answers.column("numbers")))
        (levels, _), (counts, _) = _joined(of_words, "levels", np.uint8), _joined(of_words, "counts", np.int64)
        (pair_levels, _), (numbers, _) = _joined(of_pairs, "levels", np.uint8), _joined(of_pairs, "numbers", np.uint16)
        lm = AnsweredLevels(own, levels, pair, pair_levels, histories, numbers)
        scored = docs.filter(docs.column(2))
        seen = counts > 0
        tables = {**model, "hot_words": own[seen], "hot_counts": counts[seen]}
        rows = [b for b in _scores(scored, lm, tables, dealt.column("batch")[0].as_py() << 24)] if scored.num_rows else []
        return pa.Table.from_batches([b.cast(schema) for b in rows], schema) if rows else schema.empty_table()

    return run


def probabilities(lm, model: dict, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """P(w | v) of each pair of word hashes."""
    distinct, own = np.unique(np.concatenate((w, v)), return_inverse=True)
    level, number = lm.words(distinct)
    single = (_MIDDLE[level] + 1.0) / (model["mass"] + 1.0)
    total, share = decode(number)
    at = np.searchsorted(model["hot"], distinct)
    hot = model["hot"][np.minimum(at, len(model["hot"]) - 1)] == distinct if len(model["hot"]) else np.zeros(len(distinct), bool)
    if hot.any():
        total[hot], share[hot] = model["hot_total"][at[hot]], model["hot_share"][at[hot]]
    known = (level > 0) | (distinct == START) & (model["texts"] > 0)
    w, v = own[: len(w)], own[len(w) :]
    p = np.where(known[v], share[v], 1.0) * single[w]
    both = np.flatnonzero(known[v] & known[w])
    h = distinct[v[both]]
    p[both] += (1 - share[v[both]]) * _MIDDLE[lm.pairs(h, _pairs(h, distinct[w[both]]))] / total[v[both]]
    return np.minimum(p, 1.0)


def _scores(batch: pa.RecordBatch, lm, model: dict, row: int):
    """Scored texts; ``lm`` gives the levels of words and pairs."""
    names = ["row", "i", "n_tokens", "hot_known", "hot_sum", "score", "cold"]
    hot_words, hot_counts = model["hot_words"], model["hot_counts"]
    for chunk, w, v, bounds in _sequences(batch.column(1)):
        distinct, own = np.unique(w, return_inverse=True)
        at = np.minimum(np.searchsorted(hot_words, distinct), max(len(hot_words) - 1, 0))
        hot = hot_words[at] == distinct if len(hot_words) else np.zeros(len(distinct), bool)
        logs = np.where(hot, np.log10(np.where(hot, hot_counts[at] if len(hot_words) else 0, 0) + 1.0), 0.0)
        cuts = bounds[:-1]
        hot_sum, hot_known = np.add.reduceat(logs[own], cuts), np.add.reduceat(hot[own].astype(np.int64), cuts)
        score = np.add.reduceat(np.log10(probabilities(lm, model, w, v)), cuts)
        cold = ~hot[own]
        n_cold = np.concatenate(([0], np.cumsum(np.add.reduceat(cold.astype(np.int64), cuts)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(n_cold), pa.array(w[cold].view(np.int64)))
        n = chunk.n_docs
        rows = np.arange(row, row + n)
        row += n
        yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0).slice(chunk.first, n), pa.array(np.diff(bounds)), pa.array(hot_known), pa.array(hot_sum), pa.array(score), lists], names=names)


def _score(get):
    def run(batches):
        model = get()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield from _scores(batch, model["filter"], model, row)
            row += batch.num_rows

    return run


def _pack(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["h", "c"])


@dataclass
class LanguageModel:
    """Counts of the training texts, as tables and as the parts of the filter, and the figures of the whole."""

    vocabulary: DataFrame  # word, n
    parts: DataFrame  # kind, bucket, packed, levels, probes
    buckets: int
    n_tokens: int
    n_words: int
    filter_bytes: int
    first: int  # probes of a pair's first level
    figures: dict = field(default_factory=dict)  # sent to the workers

    def whole_filter(self) -> LogFrequencyFilter:
        """The filter on the driver: at most ``MAX_FILTER_BYTES``, which ``score_texts`` sees to."""
        run, schema = _fill(self.first)
        rows = self.parts.mapInArrow(run, schema).collect()
        blocks = {(r["kind"], r["bucket"]): Block(r["size"], np.frombuffer(r["bits"], np.uint8), self.first if r["kind"] == _PAIRS else LEVEL_PROBES) for r in rows}
        return LogFrequencyFilter(self.buckets, self.figures["hot"], blocks)


def train(training: DataFrame, text_col: str = "text", scratch: Scratch | None = None) -> LanguageModel:
    """Model of the texts of ``training``: two passes, one counts words and one pairs."""
    scratch = scratch or Scratch(training.sparkSession, "lm-score")
    learn = training.select(F.col(text_col).cast("string").alias("x"))
    # hash ranges follow the number of input partitions, so that one stays small as the corpus grows
    partitions = max(1, learn.rdd.getNumPartitions())
    buckets = 1 << max(5, math.ceil(math.log2(2 * partitions)))
    run, schema = _count_words(buckets)
    counted = scratch.save(learn.mapInArrow(run, schema).groupBy("bucket").applyInArrow(_gather_words, _schema(_WORD_COLUMNS)), "words")
    vocabulary = counted.where("word IS NOT NULL").select("word", "n")
    size = counted.agg(F.sum("n"), F.count("word"), F.max(F.when(F.col("word") == int(END.astype(np.int64)), F.col("n"))), F.sum("mass"), F.sum("probes")).first()
    n_tokens, n_words, texts, mass = int(size[0] or 0), int(size[1]), int(size[2] or 0), float(size[3] or 0.0)
    often = [r["word"] for r in vocabulary.where(F.col("n") >= F.lit(max(1.0, n_tokens * HOT_SHARE))).select("word").collect()]
    often = np.unique(np.append(np.array(often, np.int64).view(np.uint64), START))
    run, schema = _count_pairs(buckets, often)
    paired = scratch.save(learn.mapInArrow(run, schema).groupBy("bucket").applyInArrow(_gather_pairs(often), _schema(_PAIR_COLUMNS)), "pairs")
    heads = paired.where("packed IS NOT NULL")
    first = SAFETY + max(1, math.ceil(math.log2(n_words + 2)))
    sums = paired.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("total").alias("total"), F.sum("followers").alias("followers")).collect()
    parts = [
        counted.where("packed IS NOT NULL").select(F.lit(_WORDS).alias("kind"), "bucket", "packed", "levels", "probes"),
        heads.select(F.lit(_PAIRS).alias("kind"), "bucket", "packed", "levels", (F.col("probes") + F.col("firsts") * first).alias("probes")),
        heads.select(F.lit(_SUMS).alias("kind"), "bucket", F.col("sum_packed").alias("packed"), F.col("sum_numbers").alias("levels"), F.col("sum_probes").alias("probes")),
    ]
    parts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    probes = parts.agg(F.sum("probes")).first()[0] or 0
    figures = _hot_figures(often, sums, mass, texts, buckets)
    return LanguageModel(vocabulary, parts, buckets, n_tokens, n_words, int(probes / math.log(2) / 8), first, figures)


def _frequent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most ``HOT_WORDS``, and their counts."""
    per_level = vocabulary.groupBy(F.floor(F.log2(F.col("n"))).alias("l")).agg(F.count("*").alias("k")).orderBy(F.desc("l")).collect()
    least, have = None, 0
    for r in per_level:
        if have + r["k"] > HOT_WORDS:
            break
        least, have = r["l"], have + r["k"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = vocabulary.where(F.floor(F.log2(F.col("n"))) >= least).mapInArrow(_pack, "h binary, c binary").collect()
    h, c = (np.concatenate([np.frombuffer(r[k], kind) for r in packed]) for k, kind in (("h", np.uint64), ("c", np.int64)))
    order = np.argsort(h)
    return h[order], c[order]


_SCORED = "hot_known long, hot_sum double, score double, cold array<long>"


def _hot_figures(often: np.ndarray, sums: list, mass: float, texts: int, buckets: int) -> dict:
    """What every worker needs of the whole: the hot words with Q and B, and the figures of single words."""
    figures = {"hot": often, "hot_total": np.ones(len(often)), "hot_share": np.ones(len(often)), "mass": mass, "texts": texts, "buckets": buckets}
    if sums:
        at = np.searchsorted(often, np.array([r["hot"] for r in sums], np.int64).view(np.uint64))
        total, followers = np.array([r["total"] for r in sums], float), np.array([r["followers"] for r in sums], float)
        figures["hot_total"][at], figures["hot_share"][at] = total, followers / (total + followers)
    return figures


def score_texts(docs: DataFrame, training: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are words and one end per text. ``training`` has the texts to learn
    from in ``text_col``, or is a condition on ``docs``. base_score adds
    log10((c + 1) / (N + V + 1)) with exact counts, score the log10
    probabilities of the model. Null and empty texts have one token, the end.
    Without training texts all counts are 0. Repeated rows are rows of their
    own; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    inside = isinstance(training, Column)
    condition = F.coalesce(training, F.lit(False)) if inside else F.lit(False)
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("x"), F.lit(True).alias("scored"), condition.alias("trained"))
    learn = base.where("trained").select("x") if inside else training.select(F.col(text_col).cast("string").alias("x"))
    kind = base.schema["i"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("i", kind), T.StructField("n_tokens", T.LongType()), *T.StructType.fromDDL(_SCORED).fields])
    lm = train(learn, "x", scratch) if _fits(learn) else None
    if lm and lm.filter_bytes <= MAX_FILTER_BYTES:
        hot_words, hot_counts = _frequent(lm.vocabulary)
        sent = spark.sparkContext.broadcast({**lm.figures, "filter": lm.whole_filter(), "hot_words": hot_words, "hot_counts": hot_counts})
        scored = scratch.save(base.select("i", "x").mapInArrow(_score(lambda: sent.value), schema), "scored")
        rare = scored.select("row", F.explode("cold").alias("word")).join(lm.vocabulary, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("cold_sum"), F.count("*").alias("cold_known"))
        out, n_tokens, n_words = scored.drop("cold").join(rare, "row", "left"), lm.n_tokens, lm.n_words
    else:
        every = base if inside else base.unionByName(learn.select(F.lit(None).cast(kind).alias("i"), "x", F.lit(False).alias("scored"), F.lit(True).alias("trained")))
        out, n_tokens, n_words = _by_ranges(every, schema, scratch)
        out = out.withColumns({"cold_sum": F.lit(0.0), "cold_known": F.lit(0)})
    width = math.log10(n_tokens + n_words + 1)
    return out.select(
        F.col("i").alias(id_col),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(width)).alias("base_score"),
        "score",
    )


def _fits(learn: DataFrame) -> bool:
    """Whether the filter may be small enough to be sent: a corpus of more than that many words can have as many pairs."""
    size = learn.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    return size <= MAX_FILTER_BYTES


def _by_ranges(base: DataFrame, schema: T.StructType, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Scores of the rows (i, x, scored, trained) with the filter in its ranges; N and V."""
    spark = base.sparkSession
    buckets = 1 << max(5, math.ceil(math.log2(2 * max(1, base.rdd.getNumPartitions()))))
    dealt = scratch.save(base.mapInArrow(_deal, "batch long, docs binary"), "dealt")
    run, asks = _ask_words(buckets)
    of_words = scratch.save(dealt.mapInArrow(run, asks).groupBy("bucket").applyInArrow(_answer_words, _schema(_WORD_ANSWERS)), "words")
    size = of_words.agg(F.sum("tokens"), F.sum("words"), F.sum("mass"), F.max(F.when(F.col("word") == int(END.astype(np.int64)), F.col("n")))).first()
    n_tokens, n_words, mass, texts = int(size[0] or 0), int(size[1] or 0), float(size[2] or 0.0), int(size[3] or 0)
    often = [r["word"] for r in of_words.where(F.col("n") >= F.lit(max(1.0, n_tokens * HOT_SHARE))).select("word").collect()]
    often = np.unique(np.append(np.array(often, np.int64).view(np.uint64), START))
    first = SAFETY + max(1, math.ceil(math.log2(n_words + 2)))
    run, asks = _ask_pairs(buckets, often)
    of_pairs = scratch.save(dealt.mapInArrow(run, asks).groupBy("bucket").applyInArrow(_answer_pairs(often, first), _schema(_PAIR_ANSWERS)), "pairs")
    sums = of_pairs.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("total").alias("total"), F.sum("followers").alias("followers")).collect()
    sent = spark.sparkContext.broadcast(_hot_figures(often, sums, mass, texts, buckets))
    columns = ["batch", "bucket", "levels", "counts", "numbers"]
    answers = of_words.where("counts IS NOT NULL").withColumn("numbers", F.lit(None).cast("binary")).select(*columns)
    answers = answers.unionByName(of_pairs.where("numbers IS NOT NULL").withColumn("counts", F.lit(None).cast("binary")).select(*columns))
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score_answered(lambda: sent.value, to_arrow_schema(schema)), schema)
    return scored.drop("cold"), n_tokens, n_words
