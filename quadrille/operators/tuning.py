"""Search of settings by tree-structured Parzen estimates.

After a few random trials, the trials so far are split into the better and the other ones; in each dimension, both get a density of
Gaussians around their values, with widths from their neighbours, and a broad one for the whole range.  A new trial is, per dimension,
the draw from the better ones' density at which the ratio of the two densities is greatest.  A batch of trials may run at once: those
that run count among the others until they end, so that a batch doesn't ask the same thing twice."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

START = 10  # random trials before the estimates begin
DRAWS = 24  # candidates of each dimension


@dataclass(frozen=True)
class Range:
    """A dimension: from low to high, both included; `log` spaces it evenly by ratios, `whole` keeps it to whole numbers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def __post_init__(self):
        if not self.low < self.high or (self.log and self.low <= 0):
            raise ValueError(f"no range: {self}")

    def inner(self, v: float) -> float:
        return math.log(v) if self.log else float(v)

    def outer(self, x: float):
        v = math.exp(x) if self.log else x
        v = min(max(round(v) if self.whole else v, self.low), self.high)
        return int(v) if self.whole else float(v)

    @property
    def bounds(self) -> tuple[float, float]:
        half = 0.5 if self.whole else 0.0  # a whole number owns half a step on both sides
        low, high = max(self.low - half, 0.5) if self.log else self.low - half, self.high + half
        return self.inner(low if not self.log or self.whole else self.low), self.inner(high)


class Density:
    """A mixture of Gaussians over a range, cut off at its ends: one for each value and a broad one."""

    def __init__(self, values: np.ndarray, low: float, high: float):
        self.low, self.high = low, high
        order = np.argsort(values, kind="stable")
        x = np.concatenate([[low], values[order], [high]])
        gap = np.maximum(x[1:-1] - x[:-2], x[2:] - x[1:-1])
        widths = np.clip(gap, (high - low) / min(100, 2 + len(values)), high - low)
        self.mean = np.append(values[order], (low + high) / 2)
        self.width = np.append(widths, high - low)
        self.mass = _normal((high - self.mean) / self.width) - _normal((low - self.mean) / self.width)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        k = rng.integers(len(self.mean), size=n)
        x = rng.normal(self.mean[k], self.width[k])
        while len(out := np.flatnonzero((x < self.low) | (x > self.high))):  # of the same Gaussian, so that each keeps its share
            x[out] = rng.normal(self.mean[k[out]], self.width[k[out]])
        return x

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.mean) / self.width
        return np.log((np.exp(-z * z / 2) / (self.width * self.mass * math.sqrt(2 * math.pi))).mean(axis=1) + 1e-300)


def _normal(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])


def propose(space: dict[str, Range], done: list[tuple[dict, float]], running: list[dict], rng: np.random.Generator, start: int = START) -> dict:
    """The next trial, given the losses of those that have ended and those that still run."""
    finite = sorted((t for t in done if math.isfinite(t[1])), key=lambda t: t[1])
    if len(finite) < start:
        return {k: r.outer(rng.uniform(*r.bounds)) for k, r in space.items()}
    good = min(math.ceil(0.1 * len(finite)) + 1, 25)
    out = {}
    for k, r in space.items():
        inner = lambda settings: np.array([r.inner(s[k]) for s in settings])  # noqa: B023, E731
        better = Density(inner([s for s, _ in finite[:good]]), *r.bounds)
        other = Density(inner([s for s, _ in finite[good:]] + running + [s for s, v in done if not math.isfinite(v)]), *r.bounds)
        x = better.draw(rng, DRAWS)
        out[k] = r.outer(float(x[np.argmax(better.log(x) - other.log(x))]))
    return out


def search(space: dict[str, Range], loss: Callable[[dict], float], trials: int, seed: int = 42, at_once: int = 1, start: int = START) -> list[tuple[dict, float]]:
    """All trials (setting, loss) in the order of their proposals; the same ones for the same seed, losses and `at_once`.

    `at_once` trials run together (each is a Spark job of its own, submitted from a thread); a trial that fails has an infinite loss and
    the search goes on, but for a search in which all fail."""
    rng = np.random.Generator(np.random.PCG64(seed))
    done: list[tuple[dict, float]] = []
    failed: Exception | None = None

    def run(setting):
        try:
            return float(loss(setting)), None
        except Exception as e:
            return math.inf, e

    with ThreadPoolExecutor(at_once) as pool:
        while len(done) < trials:
            batch: list[dict] = []
            for _ in range(min(at_once, trials - len(done))):
                batch.append(propose(space, done, batch, rng, start))
            for setting, (value, error) in zip(batch, pool.map(run, batch)):
                done.append((setting, value if not math.isnan(value) else math.inf))
                failed = error or failed
    if failed and all(v == math.inf for _, v in done):
        raise failed
    return done


def best(done: list[tuple[dict, float]]) -> tuple[dict, float]:
    return min(done, key=lambda t: t[1])


# The usual ranges of boosted trees.
TREES = {
    "leaves": Range(31, 255, whole=True), "depth": Range(4, 12, whole=True), "rate": Range(0.01, 0.15, log=True), "least_rows": Range(20, 500, whole=True),
    "feature_fraction": Range(0.5, 1.0), "bagging_fraction": Range(0.5, 1.0), "lambda_l1": Range(0.0, 5.0), "lambda_l2": Range(0.0, 5.0)}


def tune_trees(train, valid, features: list[str], target: str, trials: int = 40, space: dict[str, Range] = TREES, at_once: int = 2, seed: int = 42, **fixed) -> list[tuple[dict, float]]:
    """Trials of leaf-wise trees with their held-out mean absolute error."""
    from pyspark.sql import functions as F

    from quadrille.operators import leafwise

    def loss(setting: dict) -> float:
        model = leafwise.fit(train, valid, features, target, leafwise.Setting(**{**fixed, **setting}))
        return leafwise.score(model, valid).agg(F.avg(F.abs(F.col("predicted") - F.col(target)))).first()[0]

    return search(space, loss, trials, seed, at_once)
