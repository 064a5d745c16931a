"""Fuzzy likeness of strings, 0 to 100: best partial match and token sets.

Likeness of two strings is 200 * LCS / (total length). The partial likeness is
the best over windows of the longer string as long as the shorter one, and
over its shorter prefixes and suffixes.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one string."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & at.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, letters, best = len(a), set(a), 0.0
    for end in range(1, len(b) + n):
        lo, hi = max(0, end - n), min(end, len(b))
        # the best window starts and ends with a letter of the shorter string
        if b[hi - 1] in letters and (hi == len(b) or b[lo] in letters or lo == 0):
            best = max(best, ratio(a, b[lo:hi]))
    return best


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(sorted(both))
    one, two = (base + " " + " ".join(left)).strip(), (base + " " + " ".join(right)).strip()
    found = [ratio(one, two)]
    if base:
        found += [ratio(base, one), ratio(base, two)]
    return max(found)


def score(pattern: str, text: str) -> float:
    p, t = pattern.lower(), text.lower()
    return max(partial_ratio(p, t), token_set_ratio(p, t))


def _pieces(n: int, threshold: float) -> list[tuple[int, int]]:
    """Disjoint pieces of a pattern of n letters, one more than a match at the threshold has edits; none where letters are too few."""
    count = int(2 * n * (1 - threshold / 100)) + 1
    return [(n * k // count, n * (k + 1) // count) for k in range(count)] if count <= n else []


#: Letters of texts that are searched together.
BLOCK = 1 << 20


class Pattern:
    """A string to look for, with what its search needs."""

    def __init__(self, string: str, threshold: float):
        self.text, self.threshold = string.lower(), threshold
        self.n, self.letters, self.words = len(self.text), Counter(self.text), set(self.text.split())
        least = lambda reached: next((b for b in range(self.n + 1) if reached(b) >= threshold - 1e-9), self.n + 1)
        #: Letters in common with the pattern that a window inside a text needs, and one that is cut by an end.
        self.inside, self.cut = least(lambda b: 100.0 * b / max(self.n, 1)), least(lambda b: 200.0 * b / max(self.n + b, 1))
        self.gap = next(chr(c) for c in range(256) if chr(c) not in self.letters) if len(self.letters) < 256 else "\0"
        self.code = "latin-1" if all(c < "\u0100" for c in self.text) else "utf-32-le"

    def common(self, text: str) -> int:
        """Letters that the pattern and a text have in common, which no common subsequence exceeds."""
        return sum(min(text.count(c), k) for c, k in self.letters.items())

    def _ends(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows of the pattern's length that have enough of its letters, however placed, and how many."""
        # a letter outside of the code becomes a question mark, which can only add to what is in common
        data = np.frombuffer(joined.encode(self.code, "replace"), np.uint8 if self.code == "latin-1" else np.uint32)
        kind = np.uint8 if self.n < 256 else np.int32  # differences of running counts hold modulo 256 too
        found, shared = [], []
        for start in range(0, len(data) - self.n + 1, BLOCK):
            part = data[start : start + BLOCK + self.n - 1]
            bag = np.zeros(len(part) - self.n + 1, kind)
            run = np.zeros(len(part) + 1, kind)
            for c, k in self.letters.items():
                np.cumsum(part == ord(c), dtype=kind, out=run[1:])
                bag += np.minimum(run[self.n :] - run[: -self.n], kind(k))
            at = np.flatnonzero(bag >= min(self.inside, self.cut))
            found.append(at + start + self.n)
            shared.append(bag[at])
        return np.concatenate(found), np.concatenate(shared)

    def _search(self, texts: list[str]) -> list[float]:
        """Best likeness of windows of texts that are as long as the pattern at least; all of them are searched as one."""
        starts, at = [], self.n
        for t in texts:
            starts.append(at)
            at += len(t) + 1
        ends, shared = self._ends(self.gap * self.n + "".join(t + self.gap for t in texts) + self.gap * self.n)
        places = np.array(starts)
        best = [0.0] * len(texts)
        last, first = np.searchsorted(places, ends - 1, "right") - 1, np.searchsorted(places, ends - self.n, "right") - 1
        for p, bag, *both in zip(ends.tolist(), shared.tolist(), last.tolist(), first.tolist(), strict=True):
            for k in {*both} - {-1}:
                text, end = texts[k], p - starts[k]
                lo, hi = max(0, end - self.n), min(end, len(text))
                if lo >= hi or bag < (self.inside if hi - lo == self.n else self.cut):
                    continue
                if text[hi - 1] in self.letters and (hi == len(text) or text[lo] in self.letters or lo == 0):
                    best[k] = max(best[k], ratio(self.text, text[lo:hi]))
        return best

    def partials(self, texts: list[str]) -> list[float]:
        """``partial_ratio`` of each text where it reaches the threshold, else 0: only windows with enough of the pattern's
        letters are compared, and they are found by running counts over many texts at once."""
        out = [0.0] * len(texts)
        wait, size = [], 0
        for k, text in enumerate(texts):
            if self.text in text:
                out[k] = 100.0
            elif self.n > len(text):
                c = self.common(text)
                if not c or 200.0 * c / (len(text) + c) >= self.threshold - 1e-9:
                    out[k] = partial_ratio(self.text, text)
            else:
                wait.append(k)
                size += len(text)
            if wait and (size > BLOCK or k == len(texts) - 1):
                for i, found in zip(wait, self._search([texts[i] for i in wait]), strict=True):
                    out[i] = found
                wait, size = [], 0
        return [v if v >= self.threshold else 0.0 for v in out]

    def partial(self, text: str) -> float:
        return self.partials([text])[0]

    def token_set(self, text: str) -> float:
        """``token_set_ratio`` where it reaches the threshold, else 0: lengths alone rule most texts out."""
        other = set(text.split())
        both = self.words & other
        if not self.words or not other:
            return 0.0
        if both and (both == self.words or both == other):
            return 100.0
        base = " ".join(sorted(both))
        one = (base + " " + " ".join(sorted(self.words - other))).strip()
        size = len(base) + bool(both) + sum(map(len, other - both)) + len(other) - len(both) - 1
        most = lambda a, b: 200.0 * min(a, b) / (a + b)
        best = ratio(base, one) if both else 0.0
        if max(most(len(one), size), most(len(base), size) if both else 0.0) >= self.threshold:
            best = max(best, token_set_ratio(self.text, text))
        return best if best >= self.threshold else 0.0

    def scores(self, texts: list[str]) -> list[float]:
        """``score`` of each text where it reaches the threshold, else 0."""
        low = [t.lower() for t in texts]
        return [p if p == 100.0 else max(p, self.token_set(t)) for p, t in zip(self.partials(low), low, strict=True)]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def may_match(text: Column, pattern: str, threshold: float) -> Column:
    """False only where neither likeness can reach the threshold.

    A partial match differs in at most ``2 L (1 - t)`` edits, so that one of one
    more than that disjoint pieces of the pattern stays as it is. A token set
    match shares a token, or the text is hardly longer than the pattern.
    """
    p = pattern.lower()
    n = len(p)
    low = F.lower(text)
    some = F.length(text) <= 2 * n
    for a, b in _pieces(n, threshold):
        some = some | low.contains(p[a:b])
    for word in p.split():
        some = some | low.contains(word)
    return some


def partial_udf(threshold: float):
    """Column function (pattern, text) -> partial likeness, ignoring case, where it reaches the threshold, else 0."""

    def run(patterns: pd.Series, texts: pd.Series) -> pd.Series:
        low = texts.str.lower()
        out = pd.Series(0.0, index=texts.index)
        for pattern, some in low.dropna().groupby(patterns):
            names = some.unique().tolist()
            out[some.index] = some.map(dict(zip(names, Pattern(pattern, threshold).partials(names), strict=True)))
        return out.where(low.notna())

    return pandas_udf(run, "double")


def _score_udf(patterns: list[str], threshold: float):
    def run(texts: pd.Series) -> pd.Series:
        given = texts.fillna("").tolist()
        scores = [Pattern(p, threshold).scores(given) for p in patterns]
        return pd.Series([[{"part": k, "score": v} for k, v in enumerate(row) if v >= threshold] for row in zip(*scores, strict=True)], index=texts.index, dtype=object)

    return pandas_udf(run, "array<struct<part: bigint, score: double>>")


def matches(text: Column, patterns: list[str], threshold: float) -> Column:
    """Array of (part, string, score) of the patterns that reach the threshold in a text; one pass over the text for all."""
    names = F.array(*[F.lit(p) for p in patterns])
    return F.transform(_score_udf(patterns, threshold)(text), lambda m: F.struct(m["part"].alias("part"), F.get(names, m["part"].cast("int")).alias("string"), m["score"].alias("score")))


def scored(docs: DataFrame, patterns: list[str], id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, part, string, score) of the patterns that reach the threshold in a text."""
    if not patterns:
        return docs.select(id_col, F.lit(0).cast("long").alias("part"), F.lit("").alias("string"), F.lit(0.0).alias("score")).where("false")
    near = lambda t: reduce(Column.__or__, [may_match(t, p, threshold) for p in patterns])
    some = docs.select(id_col, F.explode(F.filter(F.array(text_col), near)).alias("__text"))
    return some.select(id_col, F.explode(matches(F.col("__text"), patterns, threshold)).alias("__m")).select(id_col, "__m.*")
