"""Gradient-boosted trees on binned features, grown leaf by leaf.

Features are cut into quantile bins once, and rows are stored as blocks of one byte a value.  A tree grows at the leaf whose split
gains most.  Gains of leaves don't depend on each other, so one job makes the histograms of gradients and Hessians of
all leaves that may still be split, not of one at a time: about as many jobs as the tree is deep.  Of two children only
the one with fewer rows is summed, the other is its parent's histogram less that.  Tasks sum their rows by (leaf, feature, bin),
Spark merges the sums, and only they come to the driver: leaves x features x bins, whatever the number of rows.

Sums are in whole numbers (multiples of 1 / `FIXED`), so that a model doesn't depend on how rows are dealt.  Scores are
written down with the blocks every `REFRESH` rounds; in between the newest trees are applied anew, so that neither plans nor
writes grow with the rounds."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import ship
from quadrille.storage import discard, materialise

FIXED = 1 << 16
REFRESH = 16
BLOCK_ROWS = 1 << 15
HELD_OUT = -1  # the node number under which the loss of held-out rows is summed
BLOCKS = "n int, bins binary, y binary, held binary, draw binary, raw binary"
SUMS = "node int, feature int, bin int, g long, h long, n long"


@dataclass(frozen=True)
class Setting:
    """What governs the growth; the names say what other libraries mean by them."""

    objective: str = "poisson"  # or squared, absolute
    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int = 0  # 0: any
    least_rows: int = 20
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bins: int = 255
    patience: int = 0  # rounds without a better held-out loss after which it stops; 0: never
    seed: int = 7


@dataclass
class Tree:
    """Nodes as arrays: an inner node sends bins up to `cut` left; a leaf has left -1 and a value."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        new = len(self.left)
        self.feature[node], self.cut[node], self.left[node], self.right[node], self.gain[node] = feature, cut, new, new + 1, gain
        for column, blank in ((self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            column += [blank, blank]
        return new, new + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node where each column of bins (features x rows) ends."""
        node = np.zeros(bins.shape[1], dtype=np.int64)
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        inner = np.flatnonzero(left[node] >= 0)
        while len(inner):
            at = node[inner]
            node[inner] = np.where(bins[feature[at], inner] <= cut[at], left[at], right[at])
            inner = inner[left[node[inner]] >= 0]
        return node


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    setting: Setting
    trees: list[Tree]
    history: list[float]  # held-out loss after each round

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return add_trees(np.full(bins.shape[1], self.base), self.trees, bins)

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Expected values of rows (rows x features, NaN for unknown)."""
        raw = self.raw(binned(values, self.edges))
        return np.exp(raw) if self.setting.objective == "poisson" else np.maximum(raw, 0.0)

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's total gain over all splits, greatest first."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(total, t.feature, t.gain)
        return sorted(zip(self.features, total.tolist()), key=lambda x: (-x[1], x[0]))


def add_trees(raw: np.ndarray, trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    for t in trees:
        raw = np.clip(raw + np.array(t.value)[t.leaf_of(bins)], -12, 12) if len(t.left) > 1 or t.value[0] else raw
    return raw


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows): 0 for NaN, else 1 + the number of edges below the value."""
    out = np.zeros((len(edges), len(values)), dtype=np.uint8)
    for f, e in enumerate(edges):
        v = values[:, f]
        out[f] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left"))
    return out


def quantile_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending distinct quantiles of each feature, from mergeable summaries of all rows."""
    share = F.lit([i / (bins - 1) for i in range(1, bins - 1)])
    got = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), share, 10_000).alias(f"q{i}") for i, c in enumerate(features))).first()
    return [np.unique(np.array(q or [], dtype=float)) for q in got]


def _blocks(rows: DataFrame, features: list[str], target: str, held: str, edges: list[np.ndarray], base: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[:-2]]
                y, out = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False).astype(float), part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.uint8)
                bins = binned(np.column_stack(cols), edges)
                draw = y.view(np.uint64).copy()
                for b in bins:
                    draw = scrambled(draw + b)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (bins, y, out, draw, np.full(len(y), base)))], names=[c.split()[0] for c in BLOCKS.split(", ")])

    chosen = rows.select(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)), F.col(target).cast("double").alias("y"), F.col(held).cast("boolean").alias("held"))
    return chosen.mapInArrow(run, BLOCKS)


def slopes(objective: str, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss by the score."""
    if objective == "poisson":
        mu = np.exp(raw)
        return mu - y, mu
    if objective == "squared":
        return raw - y, np.ones(len(y))
    if objective == "absolute":
        return np.sign(raw - y), np.ones(len(y))
    raise ValueError(f"no objective is named {objective}")


def held_out_loss(objective: str, raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    if objective == "poisson":
        return np.exp(raw) - y * raw
    return (raw - y) ** 2 if objective == "squared" else np.abs(raw - y)


def scrambled(x: np.ndarray) -> np.ndarray:
    """Even pseudo-random 64-bit numbers out of any others."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xDABA0B6EB09322E3)
    return x ^ (x >> np.uint64(29))


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * FIXED)


def block_sums(bins: np.ndarray, node: np.ndarray, wanted: list[int], g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Sums (wanted x features x bins x 3) of gradients, Hessians and rows in the wanted nodes."""
    out = np.zeros((len(wanted), len(bins), width, 3))
    for i, w in enumerate(wanted):
        at = np.flatnonzero(node == w)
        for f in range(len(bins)):
            b = bins[f, at]
            for k, v in enumerate((g[at], h[at], None)):
                out[i, f, :, k] = np.bincount(b, weights=v, minlength=width)
    return out


def _histograms(blocks: DataFrame, trees: list[Tree], tree: Tree, wanted: list[int], s: Setting, turn: int, features: int, width: int, loss: bool) -> dict[int, np.ndarray]:
    """The histogram of each wanted node of the growing tree, and under `HELD_OUT` the loss and number of held-out rows."""
    def run(batches):
        total, lost = None, np.zeros(2)
        for batch in batches:
            for n, bins, y, held, draw, raw in zip(*(c.to_pylist() for c in batch.columns)):
                bins, y, held = np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(y), np.frombuffer(held, bool)
                raw = add_trees(np.frombuffer(raw), trees, bins)
                if loss:
                    lost += fixed(held_out_loss(s.objective, raw[held], y[held])).sum(), held.sum()
                use = ~held
                if s.bagging_fraction < 1:
                    use &= scrambled(np.frombuffer(draw, np.uint64) + np.uint64(s.seed * 1_000_003 + turn)) < np.uint64(int(s.bagging_fraction * (1 << 63)) * 2)
                g, h = slopes(s.objective, raw[use], y[use])
                bins = bins[:, use]
                got = block_sums(bins, tree.leaf_of(bins), wanted, fixed(g), fixed(h), width)
                total = got if total is None else total + got
        rows = [(np.array([HELD_OUT]), *np.zeros((2, 1), dtype=int), np.array([lost[0]]), np.zeros(1), np.array([lost[1]]))]
        if total is not None:
            i, f, b = np.nonzero(total[..., 2])
            rows.append((np.array(wanted)[i], f, b, *total[i, f, b].T))
        cols = [np.concatenate(c) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols[:3]] + [pa.array(c.astype(np.int64)) for c in cols[3:]], names=[c.split()[0] for c in SUMS.split(", ")])

    got = blocks.mapInArrow(run, SUMS).groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()
    node, feature, at, g, h, n = (c.to_numpy() for c in got.columns)
    out = {}
    for w in [*wanted, HELD_OUT]:
        mine = node == w
        hist = np.zeros((features, width, 3), dtype=np.int64)
        hist[feature[mine], at[mine]] = np.column_stack([g[mine], h[mine], n[mine]])
        out[w] = hist
    return out


def best_split(hist: np.ndarray, s: Setting, allowed: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the best split of a node; ties go to the lesser feature, then the lesser cut."""
    acc = np.cumsum(hist, axis=1)[:, :-1]
    total = hist[:1].sum(axis=1, keepdims=True)
    other = total - acc
    worth = lambda x: np.maximum(np.abs(x[..., 0] / FIXED) - s.lambda_l1, 0) ** 2 / np.maximum(x[..., 1] / FIXED + s.lambda_l2, 1e-9)
    gain = worth(acc) + worth(other) - worth(total)
    gain[(acc[..., 2] < s.least_rows) | (other[..., 2] < s.least_rows)] = -np.inf
    gain[~allowed] = -np.inf
    at = int(gain.argmax())
    feature, cut = divmod(at, gain.shape[1])
    return (float(gain[feature, cut]), feature, cut) if gain.size and gain[feature, cut] > 1e-9 else None


def leaf_value(hist: np.ndarray, s: Setting) -> float:
    g, h, _ = hist[0].sum(axis=0) / FIXED
    return float(-s.rate * np.sign(g) * max(abs(g) - s.lambda_l1, 0.0) / max(h + s.lambda_l2, 1e-9))


def grow(histograms, s: Setting, allowed: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree that splits the leaf of greatest gain first, and what `histograms(tree, nodes)` gave for `HELD_OUT`.

    `tried` splits every leaf that may come next and is as yet only a proposal; the grown tree takes from it
    in the order of gains."""
    tried = Tree()
    first = histograms(tried, [0])
    hist, depth, split = {0: first[0]}, {0: 0}, {}

    def consider(node):
        if not s.depth or depth[node] < s.depth:
            if found := best_split(hist[node], s, allowed):
                split[node] = found

    consider(0)
    tree, place, leaves = Tree(), {0: 0}, 1
    queue = [(-split[0][0], 0)] if 0 in split else []
    while queue and leaves < s.leaves:
        if tried.left[queue[0][1]] < 0:  # histograms of its children are needed: make those of all that may be split
            ready = [n for _, n in heapq.nsmallest(s.leaves - leaves, queue) if tried.left[n] < 0]
            small = []
            for n in ready:
                gain, feature, cut = split[n]
                a, b = tried.split(n, feature, cut, gain)
                rows = hist[n][feature, : cut + 1, 2].sum()
                small.append((a, b, n) if 2 * rows <= hist[n][feature, :, 2].sum() else (b, a, n))
            got = histograms(tried, [a for a, _, _ in small])
            for a, b, n in small:
                hist[a], hist[b] = got[a], hist[n] - got[a]
                depth[a] = depth[b] = depth[n] + 1
                consider(a)
                consider(b)
        _, n = heapq.heappop(queue)
        gain, feature, cut = split[n]
        for child, mine in zip((tried.left[n], tried.right[n]), tree.split(place[n], feature, cut, gain)):
            place[child] = mine
            if child in split:
                heapq.heappush(queue, (-split[child][0], child))
        leaves += 1
    for n, mine in place.items():
        if tree.left[mine] < 0:
            tree.value[mine] = leaf_value(hist[n], s)
    return tree, first[HELD_OUT]


def fit(train: DataFrame, valid: DataFrame | None, features: list[str], target: str, setting: Setting = Setting()) -> Model:
    """A boosted model of the target; with `valid` and patience it stops when the loss there falls no more, and keeps the best rounds."""
    s = setting
    ship(train.sparkSession)
    use = [*features, target]
    rows = train.select(*use, F.lit(False).alias("_held"))
    edges = quantile_edges(rows.dropna(subset=[target]), features, s.bins)
    if valid is not None:
        rows = rows.unionByName(valid.select(*use, F.lit(True).alias("_held")))
    rows = rows.dropna(subset=[target])
    mean = rows.filter("not _held").agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    base = math.log(max(mean, 1e-6)) if s.objective == "poisson" else mean
    width = max([len(e) for e in edges], default=0) + 2
    blocks = materialise(_blocks(rows, features, target, "_held", edges, base), "leafwise")
    model, fresh, best = Model(features, edges, base, s, [], []), [], (math.inf, 0)
    for turn in range(s.rounds + 1):
        draw = np.random.Generator(np.random.PCG64([s.seed, turn])).permutation(len(features))
        allowed = np.zeros(len(features), dtype=bool)
        allowed[draw[: max(1, round(s.feature_fraction * len(features)))]] = True
        seen = []

        def histograms(tree, nodes):
            first = not seen
            seen.append(1)
            return _histograms(blocks, fresh, tree, nodes, s, turn, len(features), width, first and valid is not None)

        if turn == s.rounds:  # only to know the last round's loss
            lost = histograms(Tree(), [0])[HELD_OUT] if valid is not None else None
        else:
            tree, lost = grow(histograms, s, allowed)
        if turn and valid is not None:
            model.history.append(lost[0, 0, 0] / FIXED / max(lost[0, 0, 2], 1))
            best = min(best, (model.history[-1], turn))
            if s.patience and turn - best[1] >= s.patience:
                break
        if turn == s.rounds or len(tree.left) == 1:
            break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == REFRESH:
            old, blocks, fresh = blocks, materialise(_scored(blocks, fresh), "leafwise"), []
            discard(old)
    discard(blocks)
    if valid is not None and model.history:
        model.trees = model.trees[: best[1]]
    return model


def _scored(blocks: DataFrame, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' values added to their scores."""
    def run(batches):
        for batch in batches:
            n, bins, raw = (batch.column(i).to_pylist() for i in (0, 1, 5))
            new = [add_trees(np.frombuffer(r), trees, np.frombuffer(b, np.uint8).reshape(-1, k)).tobytes() for k, b, r in zip(n, bins, raw)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary())], names=batch.schema.names)

    return blocks.mapInArrow(run, BLOCKS)


def score(model: Model, df: DataFrame, name: str = "predicted") -> DataFrame:
    """Adds the expected value of every row; the model is a few KB and goes with the function."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def predict(values: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict(values.to_numpy(dtype=float)))

    return df.withColumn(name, predict(F.struct(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(model.features)))))


def choose_objective(train: DataFrame, valid: DataFrame, features: list[str], target: str, setting: Setting, objectives: tuple[str, ...] = ("poisson", "absolute")) -> list[tuple[str, float]]:
    """Held-out mean absolute error of each objective, best first."""
    out = []
    for o in objectives:
        m = fit(train, valid, features, target, Setting(**{**setting.__dict__, "objective": o}))
        out.append((o, score(m, valid).agg(F.avg(F.abs(F.col("predicted") - F.col(target)))).first()[0]))
    return sorted(out, key=lambda x: (x[1], x[0]))
