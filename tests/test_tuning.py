"""Parzen search on known functions."""

import math

import numpy as np
import pytest

from quadrille.operators import tuning
from quadrille.operators.tuning import Range

SPACE = {"a": Range(1e-4, 1.0, log=True), "b": Range(0, 50, whole=True), "c": Range(-5.0, 5.0)}


def hills(s):
    return (math.log10(s["a"]) + 2.5) ** 2 + ((s["b"] - 37) / 10) ** 2 + 0.5 * (s["c"] - 1.5) ** 2 + 0.3 * math.sin(5 * s["c"])


def test_beats_a_grid_and_random_trials_of_equal_number():
    n, ours, chance = 64, [], []
    grid = [{"a": a, "b": b, "c": c} for a in np.geomspace(1e-4, 1, 4) for b in (0, 17, 33, 50) for c in np.linspace(-5, 5, 4)]
    of_grid = min(map(hills, grid))
    for seed in range(20):
        rng = np.random.default_rng(seed)
        of_chance = min(hills({k: r.outer(rng.uniform(*r.bounds)) for k, r in SPACE.items()}) for _ in range(n))
        setting, value = tuning.best(tuning.search(SPACE, hills, n, seed))
        assert value < of_grid and isinstance(setting["b"], int)
        ours.append(value)
        chance.append(of_chance)
    floor = min(ours + chance)
    assert np.mean(ours) - floor < 0.5 * (np.mean(chance) - floor) and sum(a < b for a, b in zip(ours, chance)) >= 15


def test_same_trials_for_the_same_seed_and_batches_that_differ():
    a, b = (tuning.search(SPACE, hills, 30, 5, at_once=4) for _ in range(2))
    assert a == b and len({tuple(s.values()) for s, _ in a}) == 30
    assert tuning.search(SPACE, hills, 30, 6, at_once=4) != a and len(tuning.search(SPACE, hills, 7, 1, at_once=4)) == 7


def test_trials_stay_in_range_and_failures_go_on():
    def loss(s):
        assert all(SPACE[k].low <= v <= SPACE[k].high for k, v in s.items())
        if s["c"] > 2:
            raise RuntimeError("too far")
        return math.nan if s["b"] == 3 else hills(s)

    done = tuning.search(SPACE, loss, 60, 2)
    failed = [v == math.inf for s, v in done if s["c"] > 2]
    assert failed and all(failed) and math.isfinite(tuning.best(done)[1])
    assert sum(s["c"] > 2 for s, _ in done[30:]) < sum(s["c"] > 2 for s, _ in done[:30]) + 3  # it learns to avoid them
    with pytest.raises(RuntimeError):
        tuning.search(SPACE, lambda s: loss({**s, "c": 3.0}), 4)
    with pytest.raises(ValueError):
        Range(2, 1)


def test_densities_are_those_of_their_range():
    d = tuning.Density(np.array([0.1, 0.15, 0.9]), 0.0, 1.0)
    x = np.linspace(0, 1, 20001)
    assert abs(np.exp(d.log(x)).mean() - 1) < 1e-3
    draws = d.draw(np.random.default_rng(1), 20000)
    assert draws.min() >= 0 and draws.max() <= 1 and abs((draws < 0.3).mean() - np.exp(d.log(x[x < 0.3])).sum() / 20000) < 0.02
    whole = Range(1, 3, whole=True)
    assert {whole.outer(v) for v in np.linspace(*whole.bounds, 50)} == {1, 2, 3}
