"""Token counts that follow edits.

A document is cut into the tokenizer's pre-tokens, whose token counts do not
depend on their neighbours. They sit in the leaves of a segment tree with sums
of code points and tokens. ``build_trees`` makes the trees of a table once, to
be kept: a row has the text, and the length and tokens of each pre-token, from
which leaves and sums come back by adding. ``apply_edits`` works on kept trees
alone. An edit re-encodes from the last pre-token boundary that the edit cannot
move to the first boundary after it where old and new pre-tokens meet again,
and updates the sums on the path of the touched leaves; all other counts are
those that were kept.

The boundary before an edit: a pre-token is fixed by its own text and the two
code points after it (white space before a word, or an apostrophe before "re"),
so all that end two code points or more in front of the edit stay. After the edit, cutting goes on from a boundary as it did before, so the
first common boundary is enough.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import Scratch, unused_name

LEAF = 64
CACHE = 1 << 20
#: fixed value: the pre-token pattern that the vocabulary was built with
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Tokens of single pre-tokens, remembered."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def tokens(self, pre_token: str) -> int:
        n = self.known.get(pre_token)
        if n is None:
            n = len(self.encoding.encode_ordinary(pre_token))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[pre_token] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.cut.findall(text)


class SegmentTree:
    """Pre-tokens of one text in leaves, and sums of (code points, tokens, pre-tokens) above them.

    A leaf's strings are cut from the text when an edit touches it.
    """

    def __init__(self, text: str, lengths: np.ndarray, tokens: np.ndarray, counter: Counter):
        self.counter, self.source = counter, text
        cuts = np.arange(0, len(lengths), LEAF)
        self.lengths = [lengths[k : k + LEAF] for k in cuts] or [lengths]
        self.tokens = [tokens[k : k + LEAF] for k in cuts] or [tokens]
        self.parts: list[list[str] | None] = [None] * len(self.lengths)
        self.width = 1 << max(0, (len(self.lengths) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        if len(cuts):
            own = self.sums[self.width : self.width + len(cuts)]
            own[:, 0], own[:, 1] = np.add.reduceat(lengths, cuts), np.add.reduceat(tokens, cuts)
            own[:, 2] = np.diff(np.append(cuts, len(lengths)))
        self.offsets = np.concatenate(([0], np.cumsum(self.sums[self.width : self.width + len(self.lengths), 0])))
        low = self.width
        while low > 1:
            self.sums[low // 2 : low] = self.sums[low : 2 * low : 2] + self.sums[low + 1 : 2 * low : 2]
            low //= 2

    @classmethod
    def build(cls, text: str, counter: Counter) -> SegmentTree:
        return cls(text, *cut_text(text, counter), counter)

    def leaf(self, k: int) -> list[str]:
        if self.parts[k] is None:
            at = self.offsets[k] + np.concatenate(([0], np.cumsum(self.lengths[k])))
            self.parts[k] = [self.source[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return self.parts[k]

    def _set(self, k: int, parts: list[str], tokens: list[int]) -> None:
        self.parts[k], self.lengths[k], self.tokens[k] = parts, np.array([len(x) for x in parts], np.int64), np.array(tokens, np.int64)
        node = self.width + k
        self.sums[node] = self.lengths[k].sum(), self.tokens[k].sum(), len(parts)
        node //= 2
        while node:
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            node //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(x for k in range(len(self.parts)) for x in self.leaf(k))

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds code point ``place`` (the last one at the end), and its first code point."""
        k, start = 1, 0
        while k < self.width:
            left = int(self.sums[2 * k, 0])
            if place < start + left:
                k = 2 * k
            else:
                start += left
                k = 2 * k + 1
        k -= self.width
        if k >= len(self.parts):
            k = len(self.parts) - 1
            start = self.n_chars - int(self.sums[self.width + k, 0])
        return k, start

    def edit(self, at: int, deleted: int, inserted: str) -> int:
        """Replaces ``deleted`` code points from ``at``; returns the number of pre-tokens encoded again."""
        total = self.n_chars
        at = min(max(at, 0), total)
        deleted = min(max(deleted, 0), total - at)
        first, start = self._leaf_at(max(at - 2, 0))
        keep = 0
        while keep < len(self.leaf(first)) and start + len(self.leaf(first)[keep]) <= at - 2:
            start += len(self.leaf(first)[keep])
            keep += 1
        last, _ = self._leaf_at(min(at + deleted, max(total - 1, 0)))
        last = max(last, first)
        grow = 1
        while True:
            last = min(last, len(self.parts) - 1)
            old = [x for k in range(first, last + 1) for x in self.leaf(k)][keep:]
            text = "".join(old)
            new_text = text[: at - start] + inserted + text[at - start + deleted :]
            done = last == len(self.parts) - 1
            shift = len(inserted) - deleted
            ends, place = {}, start
            for k, x in enumerate(old):
                place += len(x)
                ends[place + shift] = k + 1
            fresh, place, meet = [], start, None
            for m in self.counter.cut.finditer(new_text):
                # the last pre-token of an unfinished window may go on beyond it
                if not done and m.end() == len(new_text):
                    break
                fresh.append(m.group())
                place = start + m.end()
                if place >= at + len(inserted) and place in ends and place - shift >= at + deleted:
                    meet = ends[place]
                    break
            if meet is not None or done:
                break
            last += grow
            grow *= 2
        known = np.concatenate([self.tokens[k] for k in range(first, last + 1)]).tolist()
        parts, tokens = self.leaf(first)[:keep] + fresh, known[:keep] + [self.counter.tokens(x) for x in fresh]
        if meet is not None:
            parts, tokens = parts + old[meet:], tokens + known[keep + meet :]
        slots = last - first + 1
        size = -(-len(parts) // slots) or 1
        for j in range(slots):
            self._set(first + j, parts[j * size : (j + 1) * size], tokens[j * size : (j + 1) * size])
        return len(fresh)


def cut_text(text: str, counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and tokens of the pre-tokens of a text."""
    parts = counter.split(text)
    return np.fromiter(map(len, parts), np.int64, len(parts)), np.fromiter(map(counter.tokens, parts), np.int64, len(parts))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(values, np.cumsum([x or 0 for x in pa.compute.list_value_length(column).to_pylist()])[:-1]) if len(column) else []


#: Texts cut at once, so that a batch of lists stays small.
TEXTS = 256


def _build(get):
    def run(batches):
        counter = get()
        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(a, TEXTS)
                texts = batch.column(1).to_pylist()
                cuts = [cut_text(x or "", counter) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x or "" for x in texts], pa.string()), _lists([c[0] for c in cuts]), _lists([c[1] for c in cuts]), *batch.columns[2:]], names=["i", "text", "lengths", "tokens", *batch.schema.names[2:]])

    return run


def _apply(get, keep: bool):
    names = ["i", "n_chars", "n_pre_tokens", "n_tokens", "edited_chars", "edited_tokens", "n_reencoded", *(["text", "lengths", "tokens"] if keep else [])]

    def run(batches):
        counter = get()
        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(a, TEXTS)
                rows, after = [], []
                for text, lengths, tokens, change in zip(batch.column(1), _arrays(batch.column(2)), _arrays(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                    tree = SegmentTree(text.as_py(), lengths, tokens, counter)
                    before = tree.n_chars, len(lengths), tree.n_tokens
                    again = sum(tree.edit(int(e["at"] or 0), int(e["deleted"] or 0), e["inserted"] or "") for e in change or () if e)
                    rows.append((*before, tree.n_chars, tree.n_tokens, again))
                    if keep:
                        after.append((tree.text, np.concatenate(tree.lengths), np.concatenate(tree.tokens)))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if keep:
                    texts, lengths, tokens = zip(*after, strict=True)
                    columns += [pa.array(texts, pa.string()), _lists(list(lengths)), _lists(list(tokens))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def _counter(spark, vocabulary: str):
    """Gives the counter in a task; the vocabulary, a file of a fixed size on the driver, is sent to the workers."""
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    return lambda: Counter(sent.value)


def build_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (i, text, lengths, tokens) with the tree of each document, and the columns ``keep``, as edits. To be written and kept."""
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("x"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)])
    schema = T.StructType([base.schema["i"], *T.StructType.fromDDL("text string, lengths array<int>, tokens array<int>").fields, *base.schema.fields[2:]])
    return base.mapInArrow(_build(_counter(docs.sparkSession, vocabulary)), schema)


def apply_edits(trees: DataFrame, vocabulary: str, edits_col: str | None = None, *, keep: bool = True) -> DataFrame:
    """Rows (i, n_chars, n_pre_tokens, n_tokens, edited_chars, edited_tokens, n_reencoded, text, lengths, tokens) from kept trees.

    The last three are the trees after the edits, to be kept in place of the
    others; without ``keep`` they are left out.
    """
    none = F.lit(None).cast("array<struct<at: bigint, deleted: bigint, inserted: string>>")
    base = trees.select("i", "text", "lengths", "tokens", (F.col(edits_col) if edits_col else none).alias("e"))
    numbers = [T.StructField(name, T.LongType()) for name in ("n_chars", "n_pre_tokens", "n_tokens", "edited_chars", "edited_tokens", "n_reencoded")]
    schema = T.StructType([base.schema["i"], *numbers, *(base.schema.fields[1:4] if keep else [])])
    return base.mapInArrow(_apply(_counter(trees.sparkSession, vocabulary), keep), schema)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, *, vocabulary: str) -> DataFrame:
    """Rows (id, n_chars, n_pre_tokens, n_tokens, edited_chars, edited_tokens, n_reencoded).

    ``edits_col`` is an array of structs (at, deleted, inserted), applied in
    order, each to the text as the ones before left it; places beyond the text
    are cut to it, and null edits or fields change nothing. Without edits the
    edited figures equal the others. Null texts are empty and have 0 tokens.
    Repeated rows are rows of their own; other columns are ignored, whatever
    their names. An empty table gives an empty result. ``vocabulary`` is the
    path of the vocabulary file on the driver.
    """
    trees = Scratch(docs.sparkSession, "token-count").save(build_trees(docs, vocabulary, id_col, text_col, (edits_col,) if edits_col else ()), "trees")
    return apply_edits(trees, vocabulary, "k0" if edits_col else None, keep=False).withColumnRenamed("i", id_col)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", order_col: str = "seq") -> tuple[DataFrame, str]:
    """``docs`` with the rows of ``edits`` (id, order, at, deleted, inserted) of each document in order, and that column's name.

    Documents without edits, null ids among them, have a null there; edits of
    unknown ids are left out; rows that repeat an id get its edits each.
    """
    name, key = unused_name(docs, "edits"), unused_name(docs, "edited_id")
    own = edits.groupBy(F.col(id_col).alias(key)).agg(F.sort_array(F.collect_list(F.struct(order_col, "at", "deleted", "inserted"))).alias("e"))
    plain = F.transform("e", lambda e: F.struct(e["at"].alias("at"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted")))
    own = own.select(key, plain.alias(name))
    return docs.join(own, docs[id_col] == own[key], "left").drop(key), name
