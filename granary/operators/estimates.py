"""Fits and probes that need a few passes of sums: beta regression, temperature, stepwise scorecards, competing risks, water balances, sensitivity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.credit import expit
from granary.functions.special import digamma, log_gamma, trigamma
from granary.operators import boosting, fits
from granary.storage import dropped, saved


def linear(beta: np.ndarray, factors: list[str]) -> Column:
    return sum([F.col(f) * float(b) for f, b in zip(factors, beta[1:], strict=True)], F.lit(float(beta[0])))


def beta_regression(rows: DataFrame, target: str, factors: list[str], steps: int = 50, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Coefficients (intercept first, on the logit) and precision of a beta regression, by Fisher scoring.

    Targets in [0, 1] are moved inside by (v (n - 1) + 1/2) / n, so that total
    losses and full recoveries stay. Every step is one pass of sums; rows with
    nulls take no part.
    """
    known = rows.select(F.col(target).cast("double").alias("v"), *[F.col(f).cast("double").alias(f) for f in factors]).dropna()
    n = known.count()
    if n < len(factors) + 2:
        raise ValueError("a beta regression needs more rows than coefficients")
    data = saved(known.select(((F.col("v") * (n - 1) + 0.5) / n).alias("y"), *factors), "beta")
    data = data.withColumn("z", F.log(F.col("y") / (1 - F.col("y"))))
    beta, _, _ = fits.least_squares(data, "z", factors)
    mu = expit(linear(beta, factors))
    spread = data.agg((F.avg(mu * (1 - mu)) / F.avg((F.col("y") - mu) ** 2) - 1).alias("s")).first()[0]
    phi = max(float(spread), 0.1)
    x = [F.lit(1.0), *map(F.col, factors)]
    k = len(x)
    for _ in range(steps):
        m = F.col("m")
        p, q = m * phi, (1 - m) * phi
        d = data.withColumn("m", expit(linear(beta, factors))).select("z", "y", *factors, (m * (1 - m)).alias("w"), "m", digamma(p).alias("dp"), digamma(q).alias("dq"), trigamma(p).alias("tp"), trigamma(q).alias("tq"))
        w, gap, tp, tq = F.col("w"), F.col("z") - F.col("dp") + F.col("dq"), F.col("tp"), F.col("tq")
        sums = {f"g{i}": phi * x[i] * w * gap for i in range(k)} | {"gphi": m * gap + F.log(1 - F.col("y")) - F.col("dq")}
        sums |= {f"h{i}_{j}": phi**2 * (tp + tq) * w**2 * x[i] * x[j] for i in range(k) for j in range(i, k)}
        sums |= {f"c{i}": phi * x[i] * w * (tp * m - tq * (1 - m)) for i in range(k)} | {"dd": tp * m**2 + tq * (1 - m) ** 2}
        r = d.agg(*[F.sum(v).alias(n_) for n_, v in sums.items()]).first()
        psi, tri = _at(rows, digamma, phi), _at(rows, trigamma, phi)
        score = np.array([r[f"g{i}"] for i in range(k)] + [r["gphi"] + n * psi])
        info = np.zeros((k + 1, k + 1))
        for i in range(k):
            info[i, k] = info[k, i] = r[f"c{i}"]
            for j in range(i, k):
                info[i, j] = info[j, i] = r[f"h{i}_{j}"]
        info[k, k] = r["dd"] - n * tri
        step = np.linalg.solve(info, score)
        while phi + step[k] <= 0:
            step = step / 2
        beta, phi = beta + step[:k], phi + float(step[k])
        if np.abs(step).max() < tolerance:
            break
    dropped(data)
    return beta, phi


def _at(rows: DataFrame, f: Callable[[Column], Column], value: float) -> float:
    return rows.sparkSession.range(1).select(f(F.lit(float(value)))).first()[0]


def temperature(rows: DataFrame, probabilities: str, label: str, low: float = 0.05, high: float = 10.0, tolerance: float = 1e-4, grid: int = 16) -> float:
    """Temperature that minimises the log loss of class probabilities (an array) for the label's index.

    The range is cut by a grid whose losses come from one pass, then narrowed
    around the best point until it is within the tolerance.
    """
    p = F.transform(F.col(probabilities), lambda v: F.log(F.greatest(v, F.lit(1e-12))))
    data = saved(rows.filter(F.col(label).isNotNull()).select(p.alias("z"), F.col(label).cast("int").alias("y")), "temperature")
    while high - low > tolerance:
        ts = [float(t) for t in np.linspace(low, high, grid)]
        loss = lambda t: F.log(F.aggregate(F.col("z"), F.lit(0.0), lambda a, v: a + F.exp(v / t))) - F.get("z", F.col("y")) / t
        r = data.agg(*[F.sum(loss(t)).alias(f"t{i}") for i, t in enumerate(ts)]).first()
        if r[0] is None:
            raise ValueError("temperature scaling needs labelled rows")
        best = int(np.argmin(list(r)))
        low, high = ts[max(best - 1, 0)], ts[min(best + 1, grid - 1)]
    dropped(data)
    return (low + high) / 2


def scaled(probabilities: Column, t: float) -> Column:
    """Class probabilities at a temperature."""
    e = F.transform(probabilities, lambda v: F.pow(F.greatest(v, F.lit(1e-12)), F.lit(1 / t)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


@dataclass
class Selection:
    features: list[str]
    coefficients: dict[str, float]
    log: list[tuple[str, float, str | None]] = field(default_factory=list)
    settled: bool = False


def stepwise(rows: DataFrame, pool: list[str], size: int, label: str = "label", minimum: int = 5, rounds: int = 25) -> Selection:
    """Scorecard features whose coefficients are all of the expected sign.

    ``pool`` are weights of evidence, best first; the first ``size`` are fitted,
    the feature with the most negative coefficient for log odds of good goes and
    the next of the pool comes in, until none is negative. ``settled`` is false
    if that was not reached.
    """
    if size < minimum:
        raise ValueError("a scorecard cannot start below its minimum")
    chosen, spare = list(pool[:size]), list(pool[size:])
    out = Selection(chosen, {})
    data = saved(rows.select(F.col(label).cast("double").alias("label"), *pool).dropna(), "stepwise")
    for turn in range(rounds + 1):
        model = fits.logistic(data, chosen)
        out.coefficients = dict(zip(chosen, [-float(c) for c in model.coefficients], strict=True))
        worst = min(chosen, key=lambda f: (out.coefficients[f], f))
        out.settled = out.coefficients[worst] >= 0
        if out.settled or turn == rounds or (len(chosen) <= minimum and not spare):
            break
        new = spare.pop(0) if spare else None
        out.log.append((worst, out.coefficients[worst], new))
        chosen = [f for f in chosen if f != worst] + ([new] if new else [])
    out.features = chosen
    dropped(data)
    return out


def shortfalls(points: dict[str, Column], best: dict[str, float], top: int = 5) -> Column:
    """array<struct(feature, shortfall)>: features furthest below the most points they can give, at most ``top`` and only where some are missing; ties by name."""
    each = F.array(*[F.struct((-(F.lit(float(best[f])) - p)).alias("s"), F.lit(f).alias("feature")) for f, p in points.items()])
    return F.transform(F.filter(F.slice(F.array_sort(each), 1, top), lambda r: r["s"] < 0), lambda r: F.struct(r["feature"].alias("feature"), (-r["s"]).alias("shortfall")))


def sensitivity(rows: DataFrame, predict: Callable[[dict[str, Column]], Column], features: list[str], by: float = 0.1) -> DataFrame:
    """(feature, mean_shift, max_shift, flips): response of a score to each feature moved up and down by a share.

    ``predict`` builds the score from columns by name, so every probe is one
    expression over the same scan. A flip is a row that both moves shift the
    same way. Features that are null throughout give no row.
    """
    at = {f: F.col(f).cast("double") for f in features}
    base = predict(at)

    def probe(f: str) -> Column:
        up, down = (predict(at | {f: at[f] * (1 + s)}) - base for s in (by, -by))
        return F.struct(F.lit(f).alias("feature"), F.when(at[f].isNotNull(), up).alias("up"), F.when(at[f].isNotNull(), down).alias("down"))

    p = rows.select(F.explode(F.array(*map(probe, features))).alias("p")).select("p.*").filter("up is not null and down is not null")
    u, d = F.col("up"), F.col("down")
    return p.groupBy("feature").agg(((F.sum(F.abs(u)) + F.sum(F.abs(d))) / (2 * F.count("*"))).alias("mean_shift"), F.max(F.greatest(F.abs(u), F.abs(d))).alias("max_shift"), F.count(F.when((u * d > 0) & (F.abs(u) > 1e-12), 1)).alias("flips"))


def monotone_breaks(rows: DataFrame, predict: Callable[[dict[str, Column]], Column], features: list[str], feature: str, grid: list[float], rising: bool = True) -> DataFrame:
    """(rows, breaks, worst): steps of a feature's grid at which a score moves the wrong way, all else as in each row."""
    if len(grid) < 2:
        raise ValueError("a monotone check needs two grid points")
    at = {f: F.col(f).cast("double") for f in features}
    ys = [predict(at | {feature: F.lit(float(v))}) for v in grid]
    gaps = F.array(*[(b - a) if rising else (a - b) for a, b in zip(ys, ys[1:], strict=False)])
    g = rows.select(F.filter(gaps, lambda x: x < -1e-12).alias("g"))
    return g.agg(F.count("*").alias("rows"), F.sum(F.size("g")).alias("breaks"), F.coalesce(F.min(F.array_min("g")), F.lit(0.0)).alias("worst"))


def competing_hazards(rows: DataFrame, features: list[str], causes: dict[str, int], monotone: dict[str, int] | None = None, **options) -> tuple[DataFrame, dict[str, boosting.Model]]:
    """Person-periods with a monthly hazard per cause (h_<name>), from one boosted fit a cause; rows: cause and the features."""
    models, out = {}, rows
    for name, code in causes.items():
        model = models[name] = boosting.fit(rows.withColumn("hit", F.coalesce((F.col("cause") == code).cast("int"), F.lit(0))), "hit", features, monotone, **options)
        bins = [c for c in out.columns]
        out = out.select("*", *model.binned()).select(*bins, model.probability().alias(f"h_{name}"))
    return out, models


def incidence(hazards: DataFrame, key: str, time: str, first: str, second: str) -> DataFrame:
    """Per period: survival and cumulative incidence of two causes, each account's periods in order.

    Where both hazards sum to more than one they are scaled to one; nulls count
    as no hazard.
    """
    a, b = F.coalesce(F.col(first), F.lit(0.0)), F.coalesce(F.col(second), F.lit(0.0))
    total = F.greatest(a + b, F.lit(1.0))
    w = Window.partitionBy(key).orderBy(time)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    h = hazards.withColumn("h1_", a / total).withColumn("h2_", b / total).withColumn("left_", F.greatest(1 - F.col("h1_") - F.col("h2_"), F.lit(0.0)))
    h = h.withColumn("alive_", F.coalesce(F.product("left_").over(before), F.lit(1.0))).withColumn("survival", F.product("left_").over(upto))
    h = h.withColumn("cif1", F.sum(F.col("alive_") * F.col("h1_")).over(upto)).withColumn("cif2", F.sum(F.col("alive_") * F.col("h2_")).over(upto))
    return h.drop("h1_", "h2_", "left_", "alive_")


def schoenfeld_trend(rows: DataFrame, beta: dict[str, float], time: str, event: str) -> DataFrame:
    """(feature, trend): correlation of time with what an event's value exceeds its risk set's weighted mean by; null without events.

    Rows are person-periods; the rows of a period are its risk set, so the means
    are one grouping by period.
    """
    names = list(beta)
    w = F.exp(sum([F.col(f) * float(b) for f, b in beta.items()], F.lit(0.0)))
    means = rows.groupBy(time).agg(*[(F.sum(w * F.col(f)) / F.sum(w)).alias(f"mean_{f}") for f in names])
    r = rows.filter(F.col(event) == 1).join(F.broadcast(means), time)
    t = F.col(time).cast("double")
    one = r.agg(*[F.corr(t, F.col(f) - F.col(f"mean_{f}")).alias(f) for f in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("trend")) for f in names])).alias("x")).select("x.*")


def balance_probability(sums: DataFrame, value: str, by: list[str], least: int = 10) -> DataFrame:
    """Probability of each accumulated water balance under a log-logistic fit to its group, by probability-weighted moments.

    Groups (series and calendar month) with fewer than ``least`` values, or
    whose fit is undefined, give null.
    """
    g = Window.partitionBy(*by)
    n, j, x = F.count(value).over(g), F.row_number().over(g.orderBy(F.asc_nulls_last(value))), F.col(value)
    r = sums.withColumn("n_", n).withColumn("j_", j)
    up = F.col("n_") - F.col("j_")
    w0, w1 = F.avg(x).over(g), F.avg(x * up / (F.col("n_") - 1)).over(g)
    w2 = F.avg(x * up * (up - 1) / ((F.col("n_") - 1) * (F.col("n_") - 2))).over(g)
    r = r.filter(F.col("n_") >= max(least, 4)).select(*sums.columns, w0.alias("w0"), w1.alias("w1"), w2.alias("w2")).filter(F.col(value).isNotNull())
    low = 6 * F.col("w1") - F.col("w0") - 6 * F.col("w2")
    r = r.withColumn("shape", F.when(F.abs(low) >= 1e-12, (2 * F.col("w1") - F.col("w0")) / low))
    s = F.col("shape")
    gg = F.when(s > 1, F.exp(log_gamma(1 + 1 / s) + log_gamma(1 - 1 / s)))
    r = r.withColumn("gg", gg).withColumn("scale", (F.col("w0") - 2 * F.col("w1")) * s / F.col("gg")).withColumn("loc", F.col("w0") - F.col("scale") * F.col("gg"))
    over = x - F.col("loc")
    p = F.when(F.col("gg").isNull(), None).when(over > 0, 1 / (1 + F.pow(F.col("scale") / over, s))).otherwise(0.0)
    return r.select(*sums.columns, p.alias("probability"))
