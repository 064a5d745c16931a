"""Signature trees: set joins by dual traversal over OR-combined bitmaps.

A leaf entry is one set: its size and a bitmap with one bit per hashed token.
A node holds the OR of its entries' bitmaps, their size range, the largest
excess (tokens beyond set bits) and, if all its entries are known to be
connected, their component. Two trees are walked together from the roots: a
pair of nodes is dropped when the size ranges cannot reach the threshold, when
the AND of the bitmaps bounds every overlap below the least one needed, or when
all entries of both are already in one component. No pair that links is lost.
"""

from __future__ import annotations

import numpy as np

BITS = 2048
FANOUT = 8
PAIR_BLOCK = 1 << 15


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes >> np.uint64(20)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).view(np.uint64)


class SignatureTree:
    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, components: np.ndarray):
        """components: integer codes, equal where two sets are known to be connected."""
        self.order = np.lexsort((bitmaps[:, 0], sizes, components))
        sizes, maps, comps = sizes[self.order], bitmaps[self.order], components[self.order]
        excess = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, excess, comps)]
        while len(self.levels[-1][1]) > FANOUT:
            maps, low, high, excess, comps = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            first, last = np.maximum.reduceat(comps, cuts), np.minimum.reduceat(comps, cuts)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, cuts, axis=0),
                    np.minimum.reduceat(low, cuts),
                    np.maximum.reduceat(high, cuts),
                    np.maximum.reduceat(excess, cuts),
                    np.where((first == last) & (last >= 0), first, -1),
                )
            )


def survivors(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the node pairs that may hold a pair with overlap/union >= num/den, and the largest likeness of those left."""
    lm, ll, lh, le, lc = left
    rm, rl, rh, re, rc = right
    ok = (lh[i] * den >= num * rl[j]) & (rh[j] * den >= num * ll[i])
    ok &= (lc[i] != rc[j]) | (lc[i] < 0)
    at = np.flatnonzero(ok)
    bound = np.zeros(0)
    if len(at):
        a, b = i[at], j[at]
        common = np.bitwise_count(lm[a] & rm[b]).sum(axis=1).astype(np.int64)
        most = np.minimum(common + np.minimum(le[a], re[b]), np.minimum(lh[a], rh[b]))
        keep = most * (num + den) >= num * (ll[a] + rl[b])
        ok[at] = keep
        bound = (most / np.maximum(ll[a] + rl[b] - most, 1))[keep]
    return ok, bound


def dual_traversal(a: SignatureTree, b: SignatureTree | None, num: int, den: int):
    """Yields arrays of candidate positions (in a's rows, in b's rows) and bounds of likeness; b None joins a with itself."""
    own = b is None
    b = a if own else b
    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[-1][1])), np.arange(len(b.levels[-1][1])), indexing="ij"))
    if own:
        i, j = i[i <= j], j[i <= j]
    stack = [(top_a, top_b, i, j)]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > PAIR_BLOCK:
            half = len(i) // 2
            stack += [(la, lb, i[:half], j[:half]), (la, lb, i[half:], j[half:])]
            continue
        keep, bound = survivors(a.levels[la], b.levels[lb], i, j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            if own:
                i, j, bound = i[i != j], j[i != j], bound[i != j]
            if len(i):
                yield a.order[i], b.order[j], bound
            continue
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        i, j = _children(i, j, len(a.levels[la - 1][1]) if down_a else 0, len(b.levels[lb - 1][1]) if down_b else 0)
        if own:
            i, j = i[i <= j], j[i <= j]
        stack.append((la - down_a, lb - down_b, i, j))


def _children(i, j, n_a, n_b):
    k = np.arange(FANOUT)
    if n_a:
        i, j = (i[:, None] * FANOUT + k).ravel(), np.repeat(j, FANOUT)
        i, j = i[i < n_a], j[i < n_a]
    if n_b:
        j, i = (j[:, None] * FANOUT + k).ravel(), np.repeat(i, FANOUT)
        i, j = i[j < n_b], j[j < n_b]
    return i, j
