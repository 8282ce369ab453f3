"""Gradient-boosted symmetric trees for yes or no, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth: level k of tree t asks whether feature[t, k] is over threshold[t, k]; the answers' bits name a leaf."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        columns = np.ascontiguousarray(x.T)
        bits = 1 << np.arange(self.feature.shape[1])
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for k, bit in enumerate(bits):
                at += bit * (columns[f[k]] > t[k])
            out += leaf[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 90, depth: int = 5, rate: float = 0.15, bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss; every level takes the split with the largest gain over all of its leaves."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [np.unique(np.concatenate([c, [(a + b) / 2 for a, b in ((v.min(), v.max()),) if a < b]])) if len(c) < 2 else c for c, v in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])  # over cuts[k] if the bin is over k
    wide = max(map(len, cuts)) + 1
    rate_yes = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(rate_yes / (1 - rate_yes)))
    score = np.full(len(y), start)
    found_f, found_t, found_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        leaf, fs, ts = np.zeros(len(y), np.int64), [], []
        for level in range(depth):
            best = (-1.0, 0, 0)
            leaves = 1 << level
            for f in range(len(cuts)):
                if not len(cuts[f]):
                    continue
                key = leaf * wide + binned[f]
                sum_g = np.bincount(key, g, leaves * wide).reshape(leaves, wide).cumsum(axis=1)
                sum_h = np.bincount(key, h, leaves * wide).reshape(leaves, wide).cumsum(axis=1)
                all_g, all_h = sum_g[:, -1:], sum_h[:, -1:]
                gain = (sum_g**2 / (sum_h + ridge) + (all_g - sum_g) ** 2 / (all_h - sum_h + ridge)).sum(axis=0)[: len(cuts[f])]
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            _, f, k = best
            fs.append(f)
            ts.append(cuts[f][k])
            leaf |= (binned[f] > k).astype(np.int64) << level
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        score += value[leaf]
        found_f.append(fs)
        found_t.append(ts)
        found_leaf.append(value)
    return Boosted(start, np.array(found_f), np.array(found_t, np.float32).astype(np.float64), np.array(found_leaf))
