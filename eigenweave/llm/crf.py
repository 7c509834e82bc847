"""Linear-chain conditional random field over two labels, on sparse binary features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: One position's active features.
Features = Sequence[str]


class LinearChain:
    """p(y | x) is proportional to exp(sum of w[y_t] . f(x_t) + T[y_t-1, y_t]), y in {0, 1}.

    Fitted by AdaGrad on the exact gradient of the conditional log-likelihood (forward-backward)
    with an L2 penalty, decoded by Viterbi. Only differences between the labels matter, so a
    feature has one weight, for label 1.
    """

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))  # first label, last label

    def scores(self, page: Sequence[Features]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in fs) for fs in page]

    def marginals(self, page: Sequence[Features]) -> tuple[np.ndarray, np.ndarray]:
        """p(y_t) and p(y_t, y_t+1)."""
        n = len(page)
        e = np.zeros((n, 2))
        e[:, 1] = self.scores(page)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = e[0] + self.ends[0]
        for t in range(1, n):
            a[t] = e[t] + np.logaddexp(a[t - 1, 0] + self.moves[0], a[t - 1, 1] + self.moves[1])
        b[-1] = self.ends[1]
        for t in range(n - 2, -1, -1):
            r = e[t + 1] + b[t + 1]
            b[t] = np.logaddexp(self.moves[:, 0] + r[0], self.moves[:, 1] + r[1])
        z = np.logaddexp(*(a[-1] + b[-1]))
        single = np.exp(a + b - z)
        pairs = np.exp(a[:-1, :, None] + self.moves + (e[1:] + b[1:])[:, None, :] - z)
        return single, pairs

    def fit(self, pages: Sequence[Sequence[Features]], labels: Sequence[Sequence[int]], epochs: int = 8, rate: float = 0.3, penalty: float = 1e-3, seed: int = 0) -> LinearChain:
        rng = np.random.default_rng(seed)
        past: dict[str, float] = {}
        past_m, past_e = np.full((2, 2), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(epochs):
            for k in rng.permutation(len(pages)):
                page, y = pages[k], np.asarray(labels[k])
                if not len(page):
                    continue
                single, pairs = self.marginals(page)
                wrong = y - single[:, 1]
                grad: dict[str, float] = {}
                for fs, g in zip(page, wrong.tolist()):
                    if abs(g) > 1e-4:
                        for f in fs:
                            grad[f] = grad.get(f, 0.0) + g
                for f, g in grad.items():
                    w = self.weights.get(f, 0.0)
                    g -= penalty * w
                    past[f] = h = past.get(f, 1e-6) + g * g
                    self.weights[f] = w + rate * g / math.sqrt(h)
                gm = -pairs.sum(axis=0) - penalty * self.moves
                np.add.at(gm, (y[:-1], y[1:]), 1)
                ge = -np.stack((single[0], single[-1])) - penalty * self.ends
                ge[0, y[0]] += 1
                ge[1, y[-1]] += 1
                past_m += gm * gm
                past_e += ge * ge
                self.moves += rate * gm / np.sqrt(past_m)
                self.ends += rate * ge / np.sqrt(past_e)
        return self

    def decode(self, page: Sequence[Features]) -> list[int]:
        """The most probable labels (Viterbi); label 0 on ties."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        (s0, s1), (z0, z1) = self.ends.tolist()
        e = self.scores(page)
        v0, v1, back = s0, s1 + e[0], []
        for x in e[1:]:
            from0, from1 = v1 + m10 > v0 + m00, v1 + m11 > v0 + m01
            v0, v1 = (v1 + m10 if from0 else v0 + m00), (v1 + m11 if from1 else v0 + m01) + x
            back.append((from0, from1))
        y = int(v1 + z1 > v0 + z0)
        out = [y]
        for step in reversed(back):
            y = int(step[y])
            out.append(y)
        return out[::-1]
