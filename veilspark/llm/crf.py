"""A linear-chain conditional random field over two labels, bad (0) and good (1).

Observations are binned line features; a weight per feature and bin adds up to
the line's log-odds of good, and a table of four transitions ties neighbours.
All chains of a batch advance together, one line per step.

Only documents are labelled. In fitting, the labels of their lines are latent:
a document's label is one more node, tied to each of its lines, and the weights
and transitions maximise the likelihood of the documents' labels (a hidden
conditional random field). What the lines are, and how they follow each other,
comes out of that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Crf:
    edges: np.ndarray  # (features, bins - 1) inner bin edges
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # 3 * features * (bins + 1) + 1
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    @property
    def width(self) -> int:
        return self.edges.shape[1] + 2  # bins, and one for "no such line"

    def codes(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(lines, 3 * features) weight numbers: the line's own bins, its predecessor's, its successor's."""
        f, w = self.edges.shape[0], self.width
        own = np.empty((len(x), f), np.int64)
        for k in range(f):
            own[:, k] = np.searchsorted(self.edges[k], x[:, k], side="right") + 1
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        full = bounds[:-1] < bounds[1:]
        before[bounds[:-1][full]] = 0
        after[bounds[1:][full] - 1] = 0
        return np.hstack([own, before, after]) + np.arange(3 * f) * w

    def odds(self, codes: np.ndarray) -> np.ndarray:
        return self.weights[codes].sum(axis=1) + self.weights[-1]

    def marginals(self, odds: np.ndarray, bounds: np.ndarray, pairs: bool = False):
        """P(good) of each line by forward-backward.

        With ``pairs`` also P(a, b) of each line (rows; 0 at first lines) and its
        predecessor as columns 2 a + b, and log Z of each chain.
        """
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        start, steps = bounds[:-1][order], int(length.max(initial=0))
        active = np.searchsorted(-length[order], -np.arange(1, steps + 1), side="right")
        m = self.moves
        a = np.zeros((len(odds), 2))
        b = np.zeros((len(odds), 2))
        for t in range(steps):
            at = start[: active[t]] + t
            if t == 0:
                a[at, 1] = odds[at]
            else:
                p = a[at - 1]
                a[at, 0] = np.logaddexp(p[:, 0] + m[0, 0], p[:, 1] + m[1, 0])
                a[at, 1] = np.logaddexp(p[:, 0] + m[0, 1], p[:, 1] + m[1, 1]) + odds[at]
        for t in range(steps - 2, -1, -1):
            at = start[: active[t + 1]] + t
            n, o = b[at + 1], odds[at + 1]
            b[at, 0] = np.logaddexp(n[:, 0] + m[0, 0], n[:, 1] + o + m[0, 1])
            b[at, 1] = np.logaddexp(n[:, 0] + m[1, 0], n[:, 1] + o + m[1, 1])
        both = a + b
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        if not pairs:
            return good
        first = np.zeros(len(odds), bool)
        first[bounds[:-1][length > 0]] = True
        at = np.flatnonzero(~first)
        joint = np.zeros((len(odds), 4))
        for i in (0, 1):
            for j in (0, 1):
                joint[at, 2 * i + j] = np.exp(a[at - 1, i] + m[i, j] + j * odds[at] + b[at, j] - z[at])
        log_z = np.zeros(len(length))
        log_z[length > 0] = z[bounds[:-1][length > 0]]
        return good, joint, log_z

    def document_odds(self, odds: np.ndarray, tie: np.ndarray, bounds: np.ndarray):
        """Log-odds of a good document, and the marginals and pairs of its lines under a bad and a good one."""
        sides = [self.marginals(odds + sign * tie, bounds, pairs=True) for sign in (-1, 1)]
        filled = np.add.reduceat(tie, bounds[:-1])  # what lines that agree with a bad document add
        return sides[1][2] - sides[0][2] - filled, sides

    def fit(self, codes: np.ndarray, labels: np.ndarray, bounds: np.ndarray, tie: np.ndarray, *, rounds: int, l2: float = 1.0, rate: float = 0.1) -> None:
        """Penalised maximum likelihood of the documents' ``labels`` by Adam; every document has a line.

        ``tie`` is how much each line weighs for its document's label. Weights
        and transitions have the same penalty.
        """
        size = 3 * self.edges.shape[0] * self.width + 1
        if not len(self.weights):
            self.weights = np.zeros(size)
        doc = np.repeat(np.arange(len(labels)), np.diff(bounds))
        flat = codes.ravel()
        state = [np.zeros(size + 4), np.zeros(size + 4)]
        for step in range(1, rounds + 1):
            logit, sides = self.document_odds(self.odds(codes), tie, bounds)
            gap = labels - 1 / (1 + np.exp(-np.clip(logit, -40, 40)))  # the expectations under both labels differ by this share
            own = gap[doc]
            line = own * (sides[1][0] - sides[0][0])
            grad = np.zeros(size + 4)
            grad[: size - 1] = np.bincount(flat, np.repeat(line, codes.shape[1]), size - 1) - l2 * self.weights[:-1]
            grad[size - 1] = line.sum()
            grad[size:] = own @ (sides[1][1] - sides[0][1]) - l2 * self.moves.ravel()
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights + move[:size]
            self.moves = self.moves + move[size:].reshape(2, 2)
