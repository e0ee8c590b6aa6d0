"""Two-label linear-chain conditional random field over many short sequences at once.

Items of all sequences lie in one matrix; sequences of similar length advance together, so the loop runs
over positions and never over single items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Score of label 1 is ``x @ weights``, of label 0 zero; ``trans[a, b]`` scores a step from a to b."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias


def groups(lengths: np.ndarray, cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of sequences of similar length: (item index [B, T], mask [B, T]); empty sequences are left out."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * lengths[order[hi]] <= cells and (
                lengths[order[hi]] <= 2 * lengths[order[lo]] + 8):
            hi += 1
        block = order[lo:hi]
        t = np.arange(lengths[block[-1]])
        mask = t < lengths[block][:, None]
        yield np.where(mask, starts[block][:, None] + t, 0), mask
        lo = hi


def _forward(u: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log sums of all label paths up to each position, [B, T, 2]."""
    a = np.zeros((*u.shape, 2))
    a[:, 0, 1] = u[:, 0]
    for t in range(1, u.shape[1]):
        p = a[:, t - 1]
        a[:, t, 0] = np.logaddexp(p[:, 0] + trans[0, 0], p[:, 1] + trans[1, 0])
        a[:, t, 1] = np.logaddexp(p[:, 0] + trans[0, 1], p[:, 1] + trans[1, 1]) + u[:, t]
    return a


def _backward(u: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    b = np.zeros((*u.shape, 2))
    for t in range(u.shape[1] - 2, -1, -1):
        n0, n1 = b[:, t + 1, 0], b[:, t + 1, 1] + u[:, t + 1]
        on = mask[:, t + 1]
        b[:, t, 0] = np.where(on, np.logaddexp(n0 + trans[0, 0], n1 + trans[0, 1]), 0)
        b[:, t, 1] = np.where(on, np.logaddexp(n0 + trans[1, 0], n1 + trans[1, 1]), 0)
    return b


def marginals(chain: Chain, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of label 1 of every item."""
    unary, out = chain.unary(x), np.zeros(len(x))
    for at, mask in groups(lengths):
        u = np.where(mask, unary[at], 0)
        s = _forward(u, chain.trans) + _backward(u, mask, chain.trans)
        out[at[mask]] = (1 / (1 + np.exp(np.clip(s[..., 0] - s[..., 1], -700, 700))))[mask]
    return out


def viterbi(chain: Chain, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best label path of every sequence; ties go to label 1."""
    unary, out = chain.unary(x), np.zeros(len(x), np.int8)
    for at, mask in groups(lengths):
        u = np.where(mask, unary[at], 0)
        rows, steps = u.shape
        best, back = np.stack([np.zeros(rows), u[:, 0]], axis=1), np.zeros((rows, steps, 2), np.int8)
        for t in range(1, steps):
            to = best[:, :, None] + chain.trans
            back[:, t] = to[:, 1] >= to[:, 0]
            best = np.where(mask[:, t, None], to.max(axis=1) + np.stack([np.zeros(rows), u[:, t]], axis=1), best)
        label, path = (best[:, 1] >= best[:, 0]).astype(np.int8), np.zeros((rows, steps), np.int8)
        for t in range(steps - 1, -1, -1):
            path[:, t] = label
            label = np.where(mask[:, t] & (t > 0), back[np.arange(rows), t, label], label)
        out[at[mask]] = path[mask]
    return out


def fit(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 150,
        rate: float = 0.1) -> Chain:
    """Maximum likelihood by Adam on the whole sample; the same sample gives the same chain."""
    f = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(f)
    std = x.std(axis=0) if len(x) else np.ones(f)
    scale = np.where(std > 1e-9, std, 1)
    z = np.clip((x - mean) / scale, -6, 6)
    params, m, v = np.zeros(f + 5), np.zeros(f + 5), np.zeros(f + 5)
    blocks = list(groups(lengths))
    n = max(1, len(x))
    for step in range(1, steps + 1) if len(x) else ():
        trans, unary, grad = params[f + 1:].reshape(2, 2), z @ params[:f] + params[f], np.zeros(f + 5)
        error = np.zeros(len(x))
        for at, mask in blocks:
            u = np.where(mask, unary[at], 0)
            a, b = _forward(u, trans), _backward(u, mask, trans)
            s = a + b
            p1 = 1 / (1 + np.exp(np.clip(s[..., 0] - s[..., 1], -700, 700)))
            error[at[mask]] = p1[mask]
            if u.shape[1] > 1:
                on, total = mask[:, 1:], np.logaddexp(s[:, :1, 0], s[:, :1, 1])
                yy, un = y[at], np.stack([np.zeros_like(u), u], axis=2)
                for i in (0, 1):
                    for j in (0, 1):
                        e = np.exp(np.minimum(0, a[:, :-1, i] + trans[i, j] + un[:, 1:, j] + b[:, 1:, j] - total))
                        seen = (yy[:, :-1] == i) & (yy[:, 1:] == j)
                        grad[f + 1 + 2 * i + j] += (e * on).sum() - (seen & on).sum()
        error -= y
        grad[:f], grad[f] = error @ z, error.sum()
        grad = grad / n + l2 * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Chain(mean, scale, params[:f], float(params[f]), params[f + 1:].reshape(2, 2).copy())
