"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees as node arrays: feature -1 marks a leaf; a row goes left where its value is at most the threshold."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots):
        self.base = base
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = (np.asarray(x) for x in (feature, threshold, left, right, value, roots))

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                feature = self.feature[at]
                going = np.flatnonzero(feature >= 0)
                if not len(going):
                    break
                node = at[going]
                low = rows[going, feature[going]] <= self.threshold[node]
                at[going] = np.where(low, self.left[node], self.right[node])
            out += self.value[at]
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def fit(rows: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Trees for P(y = 1). monotone: for each feature +1, -1 or 0; the margin never falls (rises) as the feature grows.

    A split on a constrained feature is taken only if its two values stand in order, and the halfway value bounds what
    stands below either side, so the constraint holds for whole trees and their sum.
    """
    n, m = rows.shape
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(m)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for x, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            x.append(v)
        return len(feature) - 1

    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        root = node()
        roots.append(root)
        work = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while work:
            at, own, level, low, high = work.pop()
            total_g, total_h = g[own].sum(), h[own].sum()
            value[at] = rate * float(np.clip(total_g / (total_h + ridge), low, high))
            margin_part = value[at]
            best = (1e-6, None)
            if level < depth and len(own) >= 2 * least:
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    b = binned[own, j]
                    size = len(edges[j]) + 1
                    gs, hs, ns = np.bincount(b, g[own], size).cumsum()[:-1], np.bincount(b, h[own], size).cumsum()[:-1], np.bincount(b, minlength=size).cumsum()[:-1]
                    vl, vr = gs / (hs + ridge), (total_g - gs) / (total_h - hs + ridge)
                    gain = gs * vl + (total_g - gs) * vr - total_g**2 / (total_h + ridge)
                    ok = (ns >= least) & (len(own) - ns >= least)
                    if monotone[j]:
                        ok &= monotone[j] * (np.clip(vr, low, high) - np.clip(vl, low, high)) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, float(np.clip(vl[k], low, high)), float(np.clip(vr[k], low, high))))
            if best[1] is None:
                margin[own] += margin_part
                continue
            j, k, vl, vr = best[1]
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at], right[at] = node(), node()
            goes = binned[own, j] <= k
            middle = (vl + vr) / 2
            ll, lh, rl, rh = low, high, low, high
            if monotone[j] > 0:
                lh, rl = min(high, middle), max(low, middle)
            elif monotone[j] < 0:
                ll, rh = max(low, middle), min(high, middle)
            work += [(left[at], own[goes], level + 1, ll, lh), (right[at], own[~goes], level + 1, rl, rh)]
    return Trees(base, np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32))
