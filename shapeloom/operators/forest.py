"""A member of an adaptive random forest: a Hoeffding tree that learns row by row, with detectors that replace it.

A leaf holds, for a random subset of the features, the weight, mean and spread of each class, so a tree's size is bounded by its depth,
classes and features whatever it has seen. A leaf splits when the gain of its best feature beats the second by more than the Hoeffding
bound. Rows are weighted by Poisson draws that depend on the tree and the row's number only. When the detector of a tree's errors
warns, another tree learns in the background; when it finds a drift, that one takes its place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .drift import AdaptiveWindow

_erf = np.vectorize(math.erf, otypes=[float])


@dataclass(frozen=True)
class Settings:
    """classes: number of labels, which are 0 to classes - 1. warning, drift: confidence of the detectors, None for no detector."""

    classes: int
    trees: int = 10
    depth: int = 3
    grace: float = 50.0
    delta: float = 0.01
    tie: float = 0.05
    cuts: int = 10
    rate: float = 6.0
    warning: float | None = 0.01
    drift: float | None = 0.001
    seed: int = 0


def _entropy(counts: np.ndarray) -> np.ndarray:
    """In bits, over the last axis; 0 where there is nothing."""
    total = counts.sum(axis=-1, keepdims=True)
    share = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    return -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(axis=-1)


@dataclass
class Leaf:
    features: np.ndarray
    counts: np.ndarray
    depth: int
    n: np.ndarray = field(init=False)  # weight, mean and sum of squares about it: features by classes
    mean: np.ndarray = field(init=False)
    m2: np.ndarray = field(init=False)
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    tried: float = field(init=False)
    right: np.ndarray = field(init=False)  # weights of rows that the majority and the normal model had right

    def __post_init__(self):
        shape = len(self.features), len(self.counts)
        self.n, self.mean, self.m2 = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.low, self.high = np.full(shape[0], np.inf), np.full(shape[0], -np.inf)
        self.tried, self.right = float(self.counts.sum()), np.zeros(2)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_model", "_last")}

    def _parts(self):
        """What shares() needs of the leaf alone; learn() forgets it."""
        if (made := self.__dict__.get("_model")) is None:
            total = self.counts.sum()
            by_count = self.counts / total if total > 0 else np.full(len(self.counts), 1 / len(self.counts))
            var = np.divide(np.maximum(self.m2, 0), self.n, out=np.zeros_like(self.m2), where=self.n > 0) + 1e-9
            seen = self.counts > 0
            log = np.log(by_count, out=np.zeros_like(by_count), where=by_count > 0)
            made = self._model = by_count, var, np.log(2 * np.pi * var), self.n > 1, seen, seen.any(), log
        return made

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes: by their counts, and by normal distributions of each feature within a class. The same row again is looked up."""
        if (last := self.__dict__.get("_last")) is not None and last[0] is x:
            return last[1]
        by_count, var, log_var, known, seen, some, log = self._parts()
        v = x[self.features]
        use = np.isfinite(v)
        if not use.all():
            v, known = np.where(use, v, 0.0), known & use[:, None]
        fit = -0.5 * (log_var + (v[:, None] - self.mean) ** 2 / var)
        fit = np.where(known, fit, 0.0).sum(axis=0)
        if not some:
            return by_count, by_count
        fit = np.where(seen, fit + log, -np.inf)
        normal = np.exp(fit - fit.max())
        self._last = x, (by_count, normal / normal.sum())
        return self._last[1]

    def learn(self, x: np.ndarray, y: int, weight: float) -> None:
        for k, p in enumerate(self.shares(x)):
            self.right[k] += weight * (int(p.argmax()) == y)
        self._model = self._last = None
        self.counts[y] += weight
        v = x[self.features]
        use = np.flatnonzero(np.isfinite(v))
        v = v[use]
        self.n[use, y] += weight
        off = v - self.mean[use, y]
        self.mean[use, y] += weight * off / self.n[use, y]
        self.m2[use, y] += weight * off * (v - self.mean[use, y])
        self.low[use], self.high[use] = np.minimum(self.low[use], v), np.maximum(self.high[use], v)

    def best_split(self, s: Settings):
        """(feature, threshold, counts to the left, counts to the right) if one is due, else None."""
        total = float(self.counts.sum())
        if self.depth >= s.depth or total - self.tried < s.grace or (self.counts > 0).sum() < 2:
            return None
        self.tried = total
        usable = np.flatnonzero(self.high > self.low)
        if not len(usable):
            return None
        step = np.arange(1, s.cuts + 1) / (s.cuts + 1)
        at = self.low[usable, None] + (self.high - self.low)[usable, None] * step  # features by cuts
        n, mean = self.n[usable, None, :], self.mean[usable, None, :]
        sd = np.sqrt(np.divide(np.maximum(self.m2[usable, None, :], 0), n, out=np.zeros_like(n), where=n > 0))
        apart = at[:, :, None] - mean
        z = np.divide(apart, sd * math.sqrt(2), out=np.where(apart >= 0, 9.0, -9.0), where=sd > 0)
        left = n * 0.5 * (1 + _erf(z))
        rest = n - left
        share = left.sum(axis=2) / np.maximum(n.sum(axis=2), 1e-12)
        gain = _entropy(np.broadcast_to(n, left.shape).copy()) - share * _entropy(left) - (1 - share) * _entropy(rest)
        best = gain.max(axis=1)
        order = np.argsort(-best, kind="stable")
        second = max(float(best[order[1]]), 0.0) if len(order) > 1 else 0.0
        reach = math.log2(max(2, int((self.counts > 0).sum())))
        bound = math.sqrt(reach * reach * math.log(1 / s.delta) / (2 * total))
        f = order[0]
        if best[f] <= 0 or not (best[f] - second > bound or bound < s.tie):
            return None
        c = int(gain[f].argmax())
        return int(self.features[usable[f]]), float(at[f, c]), left[f, c], rest[f, c]


class HoeffdingTree:
    """Splits are [feature, threshold, left, right]; a value up to the threshold goes left, any other (and none) right."""

    def __init__(self, settings: Settings, tree: int, birth: int = 0):
        self.s, self.tree, self.birth, self.leaves, self.root = settings, tree, birth, 0, None

    def _leaf(self, features: int, counts: np.ndarray, depth: int) -> Leaf:
        rng = np.random.default_rng([self.s.seed, self.tree, self.birth, self.leaves])
        self.leaves += 1
        own = np.sort(rng.choice(features, min(features, round(math.sqrt(features)) + 1), replace=False))
        return Leaf(own, counts.astype(float), depth)

    def _find(self, x: np.ndarray):
        above, node = None, self.root
        while isinstance(node, list):
            above = node, 2 if x[node[0]] <= node[1] else 3
            node = node[above[1]]
        return above, node

    def shares(self, x: np.ndarray) -> np.ndarray:
        if self.root is None:
            return np.full(self.s.classes, 1 / self.s.classes)
        leaf = self._find(x)[1]
        return leaf.shares(x)[int(leaf.right[1] > leaf.right[0])]

    def learn(self, x: np.ndarray, y: int, weight: float) -> None:
        if self.root is None:
            self.root = self._leaf(len(x), np.zeros(self.s.classes), 0)
        above, leaf = self._find(x)
        leaf.learn(x, y, weight)
        if found := leaf.best_split(self.s):
            f, t, a, b = found
            node = [f, t, self._leaf(len(x), a, leaf.depth + 1), self._leaf(len(x), b, leaf.depth + 1)]
            if above is None:
                self.root = node
            else:
                above[0][above[1]] = node


class Member:
    """One tree of the forest with its background tree, detectors and accuracy."""

    def __init__(self, settings: Settings, tree: int):
        self.s, self.tree, self.drifts, self.warnings, self.births = settings, tree, 0, 0, 0
        self._begin(HoeffdingTree(settings, tree))

    def _begin(self, model: HoeffdingTree) -> None:
        self.model, self.background, self.hits, self.seen = model, None, 0, 0
        self.on_warning, self.on_drift = (AdaptiveWindow(d) if d is not None else None for d in (self.s.warning, self.s.drift))

    def _new(self) -> HoeffdingTree:
        self.births += 1
        return HoeffdingTree(self.s, self.tree, self.births)

    @staticmethod
    def _worse(detector: AdaptiveWindow | None, error: float) -> bool:
        if detector is None:
            return False
        before = detector.mean if detector.width else 0.0
        return detector.update(error) and detector.mean > before

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Shares of the classes, times the tree's accuracy so far (1 for a tree that has seen nothing)."""
        return self.model.shares(x) * (self.hits / self.seen if self.seen else 1.0)

    def learn(self, x: np.ndarray, y: int, number: int) -> None:
        """Learn the row of this number: its weight is a draw by tree and number."""
        error = float(int(self.model.shares(x).argmax()) != y)
        self.seen, self.hits = self.seen + 1, self.hits + 1 - int(error)
        weight = float(np.random.default_rng([self.s.seed, self.tree, number]).poisson(self.s.rate))
        if weight > 0:
            self.model.learn(x, y, weight)
            if self.background is not None:
                self.background.learn(x, y, weight)
        if self._worse(self.on_warning, error):
            self.warnings += 1
            self.background = self._new()
            self.on_warning = AdaptiveWindow(self.s.warning)
        if self._worse(self.on_drift, error):
            self.drifts += 1
            self._begin(self.background or self._new())
