"""Vectorised word kernels: bytes of a batch of texts to word and shingle hashes.

A word is a run of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. Separators are
single ASCII bytes, so the UTF-8 bytes are cut without decoding. Everything
here works inside one task on one Arrow batch, cut into chunks of a few MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 2 << 20
LONG_WORD = 1024

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
IS_PUNCT = np.zeros(256, dtype=bool)
IS_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xC2B2AE3D27D4EB4F)
_C3 = np.uint64(0xFF51AFD7ED558CCD)
_C4 = np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29, _S32 = np.uint64(33), np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S33)
    h = h * _C3
    h ^= h >> _S33
    h *= _C4
    h ^= h >> _S33
    return h


@dataclass
class Chunk:
    """Texts ``first .. first+n_docs-1`` of a batch, and their words in order."""

    first: int
    n_docs: int
    data: np.ndarray  # bytes, lower-cased where asked for
    offsets: np.ndarray  # n_docs + 1 byte offsets into data
    doc: np.ndarray  # text of each word, counted from the chunk's start
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    hash: np.ndarray  # uint64 of each word
    bounds: np.ndarray  # n_docs + 1 offsets into the words


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or one longer text alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time for all spans together."""
    length = end - start
    h = length.astype(np.uint64) * _C2
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    alive, left, at = None, length, start
    k = 0
    while k * 8 < LONG_WORD:
        take = np.minimum(left, 8)
        v = eight[at] & _MASK[take]
        part = h if alive is None else h[alive]
        part = (part ^ v) * _C1
        part ^= part >> _S29
        if alive is None:
            h = part
        else:
            h[alive] = part
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        alive = more if alive is None else alive[more]
        left, at = left[more] - 8, at[more] + 8
        k += 1
    out = mix(h)
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed=7)
    return out


def word_chunks(column: pa.Array, *, lower: bool = True, strip_punct: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Words of each text. ``strip_punct`` drops ASCII punctuation before cutting."""
    all_data, all_offsets = utf8(column)
    for a, b in pieces(all_offsets, limit):
        data = all_data[all_offsets[a] : all_offsets[b]]
        offsets = all_offsets[a : b + 1] - all_offsets[a]
        if strip_punct:
            keep = ~IS_PUNCT[data]
            kept = np.concatenate(([0], np.cumsum(keep)))
            data, offsets = data[keep], kept[offsets]
        if lower:
            data = LOWER[data]
        yield cut(data, offsets, a)


def cut(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Chunk:
    n = len(data)
    n_docs = len(offsets) - 1
    inside = ~IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    return Chunk(first, n_docs, data, offsets, doc, start, end, hash_spans(data, start, end), bounds)


def shingle_hashes(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word ``width``-shingles in order, and ``n_docs + 1`` bounds.

    A text with fewer words, but at least one, has its whole sequence as one.
    """
    counts = np.diff(chunk.bounds)
    n = len(chunk.hash)
    per_doc = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(per_doc)))
    rolling = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width if len(rolling) else 0):
        rolling = (rolling ^ chunk.hash[k : k + len(rolling)]) * _C1
        rolling ^= rolling >> _S32
    out = np.zeros(bounds[-1], np.uint64)
    full = counts >= width
    at = np.repeat(chunk.bounds[:-1] - bounds[:-1], per_doc) + np.arange(bounds[-1])
    whole = np.repeat(full, per_doc)
    out[whole] = mix(rolling[at[whole]])
    for d in np.flatnonzero((counts > 0) & ~full):
        h = np.uint64(counts[d])
        for w in chunk.hash[chunk.bounds[d] : chunk.bounds[d + 1]]:
            h = np.uint64(((int(h) ^ int(w)) * int(_C2)) & 0xFFFFFFFFFFFFFFFF)
            h ^= h >> _S29
        out[bounds[d]] = mix(np.array([h ^ _C4]))[0]
    return out, bounds


def distinct_per_doc(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, concatenated, and their bounds."""
    parts, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for d in range(len(bounds) - 1):
        if bounds[d + 1] > bounds[d]:
            s = np.sort(hashes[bounds[d] : bounds[d + 1]])
            if len(s) > 1:
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
            parts.append(s)
            sizes[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))
