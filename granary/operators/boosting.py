"""Gradient boosting with monotone constraints: histograms on the cluster, split search on the driver.

Rows are binned once and written to the shared folder. Each level of a tree
needs one aggregation of gradients by (node, feature, bin), whose size depends
on bins and nodes, not rows. A tree is a column expression, so scoring needs
no Python.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.storage import saved


@dataclass
class Node:
    value: float = 0.0
    cover: float = 0.0
    feature: int = -1
    cut: int = -1
    low: "Node | None" = None
    high: "Node | None" = None


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[Node] = field(default_factory=list)

    def binned(self) -> list[Column]:
        """Bin of each feature: how many edges lie below its value; null is in the first bin."""
        return [sum([F.coalesce((F.col(f) > e).cast("int"), F.lit(0)) for e in es], F.lit(0)).alias(f"b{i}") for i, (f, es) in enumerate(zip(self.features, self.edges, strict=True))]

    def margin(self) -> Column:
        """Log odds, over binned rows."""
        return sum([self.rate * tree_value(t) for t in self.trees], F.lit(self.base))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def tree_value(n: Node) -> Column:
    if n.low is None:
        return F.lit(float(n.value))
    return F.when(F.col(f"b{n.feature}") <= n.cut, tree_value(n.low)).otherwise(tree_value(n.high))


def leaf_of(n: Node, leaves: list[Node]) -> Column:
    """Number of a row's leaf among ``leaves``; -1 for others."""
    if n.low is None:
        return F.lit(next((i for i, x in enumerate(leaves) if x is n), -1))
    return F.when(F.col(f"b{n.feature}") <= n.cut, leaf_of(n.low, leaves)).otherwise(leaf_of(n.high, leaves))


def best_split(g: np.ndarray, h: np.ndarray, sign: int, l2: float, least: float, bounds: tuple[float, float]) -> tuple[float, int, float, float]:
    """(gain, cut, low value, high value) of the best split of one feature's histogram that keeps the sign of its effect and the bounds."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    low, high = (np.clip(-a / (b + l2), *bounds) for a, b in ((gl, hl), (gr, hr)))
    score = lambda v, a, b: -(a * v + 0.5 * (b + l2) * v * v)
    whole = float(np.clip(-g.sum() / (h.sum() + l2), *bounds))
    gain = score(low, gl, hl) + score(high, gr, hr) - score(whole, g.sum(), h.sum())
    ok = (hl >= least) & (hr >= least)
    if sign:
        ok &= sign * (high - low) >= 0
    gain = np.where(ok, gain, -np.inf)
    if not len(gain) or not np.isfinite(gain.max()):
        return -np.inf, -1, 0.0, 0.0
    k = int(gain.argmax())
    return float(gain[k]), k, float(low[k]), float(high[k])


def fit(rows: DataFrame, label: str, features: list[str], monotone: dict[str, int] | None = None, trees: int = 10, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 1.0, bins: int = 32, weight: str | None = None) -> Model:
    """Boosted trees for a 0/1 label; ``monotone`` gives 1 or -1 for features whose effect may only rise or fall; ``weight`` names a column of row weights."""
    signs = [int((monotone or {}).get(f, 0)) for f in features]
    cuts = rows.approxQuantile(features, [i / bins for i in range(1, bins)], 1e-3)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    mean = rows.agg(F.sum(w * F.col(label).cast("double")) / F.sum(w)).first()[0] or 0.5
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    model = Model(features, [sorted(set(c)) for c in cuts], math.log(mean / (1 - mean)), rate)
    data = saved(rows.select(F.col(label).cast("double").alias("y"), w.alias("w"), *model.binned()), "binned")
    for _ in range(trees):
        p = model.probability()
        root = Node()
        frontier = [(root, (-np.inf, np.inf))]
        for level in range(depth + 1):
            leaves = [n for n, _ in frontier]
            x = data.select(leaf_of(root, leaves).alias("leaf"), (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"), F.posexplode(F.array(*[f"b{i}" for i in range(len(features))])).alias("feature", "bin")).filter("leaf >= 0")
            got = x.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            hist = np.zeros((len(leaves), len(features), bins + 1, 2))
            for r in got:
                hist[r["leaf"], r["feature"], r["bin"]] = r["g"], r["h"]
            after = []
            for i, (n, bounds) in enumerate(frontier):
                g, h = hist[i, 0].sum(axis=0)
                n.cover, n.value = float(h), float(np.clip(-g / (h + l2), *bounds))
                if level == depth:
                    continue
                found = [(*best_split(hist[i, j, :, 0], hist[i, j, :, 1], signs[j], l2, least, bounds), j) for j in range(len(features))]
                gain, cut, low, high, j = max(found, key=lambda f: (f[0], -f[4]))
                if gain <= 1e-9:
                    continue
                n.feature, n.cut, n.low, n.high = j, cut, Node(low), Node(high)
                middle = (low + high) / 2
                # What lies below a constrained split may not cross its middle.
                a, b = {1: ((bounds[0], middle), (middle, bounds[1])), -1: ((middle, bounds[1]), (bounds[0], middle)), 0: (bounds, bounds)}[signs[j]]
                after += [(n.low, a), (n.high, b)]
            frontier = after
            if not frontier:
                break
        model.trees.append(root)
    return model


def expectation(n: Node, row: list[int], known: frozenset[int]) -> float:
    """Value of a tree with only some features known: unknown splits weigh their sides by cover."""
    if n.low is None:
        return n.value
    if n.feature in known:
        return expectation(n.low if row[n.feature] <= n.cut else n.high, row, known)
    total = n.low.cover + n.high.cover
    return (n.low.cover * expectation(n.low, row, known) + n.high.cover * expectation(n.high, row, known)) / total if total else n.value


def used(n: Node) -> set[int]:
    return set() if n.low is None else {n.feature} | used(n.low) | used(n.high)


def shapley(model: Model, row: list[int]) -> dict[str, float]:
    """Exact Shapley values of a binned row, over the features each tree uses."""
    out = dict.fromkeys(model.features, 0.0)
    for t in model.trees:
        players = sorted(used(t))
        n = len(players)
        for j in players:
            others = [k for k in players if k != j]
            for size in range(n):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                for s in itertools.combinations(others, size):
                    out[model.features[j]] += model.rate * weight * (expectation(t, row, frozenset(s) | {j}) - expectation(t, row, frozenset(s)))
    return out


def fit_binning(values: np.ndarray, goods: np.ndarray, bads: np.ndarray, share: float = 0.05, prebins: int = 20) -> list[tuple[float, float, float]]:
    """(upper edge, weight of evidence, information value) of monotone bins, from counts per distinct ascending value.

    Quantile bins are merged while one is small or holds one label only, then
    neighbours that break the better direction are pooled.
    """
    n = goods + bads
    total, upto = n.sum(), np.cumsum(n)
    which = np.minimum((upto - 1) * prebins // total, prebins - 1).astype(int)
    groups = [[values[which == k].max(), goods[which == k].sum(), bads[which == k].sum()] for k in np.unique(which)]

    def pool(g: list, i: int) -> None:
        g[i] = [g[i + 1][0], g[i][1] + g[i + 1][1], g[i][2] + g[i + 1][2]]
        del g[i + 1]

    while len(groups) > 1:
        small = [i for i, (_, a, b) in enumerate(groups) if a + b < share * total or a == 0 or b == 0]
        if not small:
            break
        i = min(small, key=lambda k: groups[k][1] + groups[k][2])
        left = i == len(groups) - 1 or (i > 0 and groups[i - 1][1] + groups[i - 1][2] < groups[i + 1][1] + groups[i + 1][2])
        pool(groups, i - 1 if left else i)
    all_good, all_bad = goods.sum(), bads.sum()

    def evidence(g: list) -> list[tuple[float, float, float]]:
        out = []
        for edge, a, b in g:
            pa, pb = max(a, 0.5) / all_good, max(b, 0.5) / all_bad
            out.append((float(edge), math.log(pa / pb), float((pa - pb) * math.log(pa / pb))))
        return out

    best: list[tuple[float, float, float]] = []
    for sign in (1, -1):
        g = [list(x) for x in groups]
        i = 0
        while i < len(g) - 1:
            rate = lambda x: x[2] / (x[1] + x[2])
            if sign * (rate(g[i + 1]) - rate(g[i])) < 0:
                pool(g, i)
                i = max(i - 1, 0)
            else:
                i += 1
        found = evidence(g)
        if not best or sum(x[2] for x in found) > sum(x[2] for x in best) + 1e-12:
            best = found
    return best


def bandit_sums(log: DataFrame, arm: str, context: list[str], reward: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per arm I + sum of x x' and sum of reward x, in one aggregation over the log."""
    d = len(context)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"a{i}_{j}") for i, a in enumerate(context) for j, b in enumerate(context)] + [F.sum(F.col(reward) * F.col(a)).alias(f"r{i}") for i, a in enumerate(context)]
    return {r[arm]: (np.eye(d) + np.array([[r[f"a{i}_{j}"] for j in range(d)] for i in range(d)], float), np.array([r[f"r{i}"] for i in range(d)], float)) for r in log.groupBy(arm).agg(*sums).collect()}


def upper_confidence(sums: dict[str, tuple[np.ndarray, np.ndarray]], context: list[str], alpha: float) -> Column:
    """The arm of the greatest upper confidence bound for a row's context; ties to the first name."""
    scored = []
    for arm in sorted(sums):
        a, b = sums[arm]
        inverse = np.linalg.inv(a)
        theta = inverse @ b
        mean = sum([F.lit(float(theta[i])) * F.col(c) for i, c in enumerate(context)], F.lit(0.0))
        spread = sum([F.lit(float(inverse[i, j])) * F.col(p) * F.col(q) for i, p in enumerate(context) for j, q in enumerate(context)], F.lit(0.0))
        scored.append((arm, mean + alpha * F.sqrt(F.greatest(spread, F.lit(0.0)))))
    top = F.greatest(*[s for _, s in scored]) if len(scored) > 1 else scored[0][1]
    return F.coalesce(*[F.when(s == top, F.lit(arm)) for arm, s in scored])
