"""What each query without a SQL counterpart must fulfil, computed plainly from its own inputs. Each takes (spark, sf, rows)."""

import hashlib
import hmac
import math
import re
from collections import Counter, defaultdict

import numpy as np

from granary.functions import passages, text
from granary.plans import learning, models
from granary.sources.tables import account_months, scored_rows, table


def scored(spark, sf):
    return scored_rows(spark, sf).toPandas()


def guard_redaction(spark, sf, rows):
    want = {}
    for r in table(spark, sf, "documents").collect():
        t, counts = r["text"], {}
        for kind, pattern in text.PERSONAL:
            if t is not None:
                t, counts[kind] = re.subn(pattern, f"[REDACTED:{kind}]", t, flags=re.ASCII)
        want[r["doc_id"]] = (t, counts)
    for r in rows:
        t, counts = want[r["doc_id"]]
        assert r["text"] == t and all(r[k] == n for k, n in counts.items())


def graph_louvain(spark, sf, rows):
    """No single node gains by a move, communities are connected, and every node has one."""
    e = defaultdict(float)
    for r in models.edges(spark, sf).collect():
        e[(r["a"], r["b"])] += r["w"]
    home = {r["node"]: r["community"] for r in rows}
    assert len(home) == len(rows) and set(home) == {n for pair in e for n in pair}
    if not e:
        return
    near = defaultdict(lambda: defaultdict(float))
    for (a, b), w in e.items():
        near[a][b] += w
        near[b][a] += w
    degree = {n: sum(v.values()) for n, v in near.items()}
    m2 = sum(degree.values())
    modularity = sum(2 * w for (a, b), w in e.items() if home[a] == home[b]) / m2 - sum((sum(degree[n] for n in home if home[n] == c) / m2) ** 2 for c in set(home.values()))
    alone = -sum((d / m2) ** 2 for d in degree.values())
    assert modularity >= max(alone, 0)
    for c in set(home.values()):
        members = {n for n in home if home[n] == c}
        seen, queue = set(), [next(iter(members))]
        while queue:
            n = queue.pop()
            if n not in seen:
                seen.add(n)
                queue += [k for k in near[n] if k in members]
        assert seen == members


def calibration_isotonic(spark, sf, rows):
    """Non-decreasing, and at every score the max-min formula of isotonic regression."""
    p = scored(spark, sf).groupby("score")["label"].agg(["sum", "count"])
    s, n = np.append(0, p["sum"].cumsum()), np.append(0, p["count"].cumsum())
    got = {r["score"]: r["fitted"] for r in rows}
    for i, score in enumerate(p.index):
        want = max(min((s[j + 1] - s[k]) / (n[j + 1] - n[k]) for j in range(i, len(p))) for k in range(i + 1))
        assert math.isclose(got[score], want, rel_tol=1e-9)


def calibration_platt(spark, sf, rows):
    """The gradient of the likelihood (of smoothed targets) vanishes, or nearly so, at the coefficients."""
    p = scored(spark, sf)
    z = 1 / (1 + np.exp(-(rows[0]["slope"] * p["score"] + rows[0]["intercept"])))
    assert abs((z - p["label"]).mean()) < 1e-3 and abs(((z - p["label"]) * p["score"]).mean()) < 1e-3


def calibration_reliability(spark, sf, rows):
    p = scored(spark, sf).sort_values("score")
    assert sum(r["n"] for r in rows) == len(p) and len(rows) <= 10
    at = 0
    for r in sorted(rows, key=lambda r: r["bin"]):
        part = p.iloc[at : at + r["n"]]
        at += r["n"]
        assert at == len(p) or p["score"].iloc[at] > part["score"].iloc[-1]
        assert math.isclose(r["predicted"], part["score"].mean()) and math.isclose(r["observed"], part["label"].mean())


def _daily(spark, sf):
    out = defaultdict(list)
    for r in models.daily(spark, sf).collect():
        out[r["series"]].append((r["moment"], r["x"]))
    return {s: sorted(v) for s, v in out.items()}


def changepoint_bayesian(spark, sf, rows):
    got = defaultdict(dict)
    for r in rows:
        got[r["series"]][r["moment"]] = r["probability"]
    series = _daily(spark, sf)
    assert set(got) == set(series)
    for s, v in series.items():
        assert set(got[s]) == {m for m, _ in v} and all(0 <= p <= 1 for p in got[s].values())


def changepoint_adaptive_window(spark, sf, rows):
    """Every series was lifted in its middle: the cut lies within a week of it wherever one is found, and most are."""
    series, found = _daily(spark, sf), defaultdict(list)
    for r in rows:
        found[r["series"]].append([m for m, _ in series[r["series"]]].index(r["moment"]))
    for s, places in found.items():
        assert all(p >= len(series[s]) // 2 - 7 for p in places)


def anomaly_seasonal(spark, sf, rows):
    series = {s: dict(v) for s, v in _daily(spark, sf).items()}
    assert all(series[r["series"]][r["moment"]] == r["x"] for r in rows) and len(rows) <= sum(0.1 * len(v) + 1 for v in series.values())


def drought_standardised_index(spark, sf, rows):
    """Within a series and calendar month the index rises with the three-month sum, and lies within its limits."""
    by = defaultdict(list)
    for r in rows:
        by[r["series"]].append((r["moment"], r["spi"]))
    assert all(z is None or abs(z) <= 3.09 + 1e-9 for v in by.values() for _, z in v)
    o = table(spark, sf, "orders").selectExpr("o_custkey % 5 as s", "year(o_orderdate) * 12 + month(o_orderdate) as m", "o_totalprice as x").groupBy("s", "m").sum("x").collect()
    sums = defaultdict(dict)
    for r in o:
        sums[r["s"]][r["m"]] = r["sum(x)"]
    for s, v in by.items():
        v.sort()
        three = {i: sum(sums[s][m] for m, _ in v[i - 2 : i + 1]) for i in range(2, len(v))}
        for k in range(12):
            pairs = sorted((three[i], v[i][1]) for i in range(k, len(v), 12) if i in three and v[i][1] is not None)
            assert all(b[1] >= a[1] - 1e-9 for a, b in zip(pairs, pairs[1:]))


def anomaly_isolation_forest(spark, sf, rows):
    l = table(spark, sf, "lineitem")
    assert len(rows) == l.count() and all(0 < r["anomaly"] < 1 for r in rows)
    # Lines at the ends of all three measures are more isolated than those in the middle.
    x = {((r["l_orderkey"] * 10 + r["l_linenumber"]) * 1_000_003 + r["l_partkey"]): r for r in l.collect()}
    price = np.array([r["l_extendedprice"] for r in x.values()])
    low, high = np.quantile(price, [0.01, 0.99])
    odd = [r["anomaly"] for r in rows if not low <= x[r["id"]]["l_extendedprice"] <= high]
    assert np.mean(odd) > np.mean([r["anomaly"] for r in rows])


def _auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        same = p == v
        rank[same] = rank[same].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def _every_row(spark, sf, rows, column):
    base = scored(spark, sf)
    assert Counter(r["id"] for r in rows) == Counter(base["id"]) and all(0 <= r[column] <= 1 for r in rows)
    return base


def model_out_of_fold(spark, sf, rows):
    _every_row(spark, sf, rows, "score")
    assert abs(_auc(np.array([r["label"] for r in rows]), np.array([r["score"] for r in rows])) - 0.5) < 0.1


def model_out_of_fold_by_group(spark, sf, rows):
    _every_row(spark, sf, rows, "score")


def model_boosted(spark, sf, rows):
    """Probabilities average to the rate of the label, and never fall with the first score within one of the second."""
    base = _every_row(spark, sf, rows, "probability")
    assert abs(np.mean([r["probability"] for r in rows]) - base["label"].mean()) < 0.02
    p = {r["id"]: r["probability"] for r in rows}
    base = base.drop_duplicates("id", keep=False)
    base = base.assign(p=base["id"].map(p))
    for _, part in base.groupby("score2"):
        assert (np.diff(part.sort_values("score")["p"]) >= -1e-12).all()


def model_fraud(spark, sf, rows):
    """Weighted to balance: probabilities lie around a half, above the label's rate."""
    base = _every_row(spark, sf, rows, "probability")
    assert abs(np.mean([r["probability"] for r in rows]) - 0.5) < 0.1 and base["label"].mean() < 0.4


def model_random_forest(spark, sf, rows):
    base = _every_row(spark, sf, rows, "probability")
    assert abs(np.mean([r["probability"] for r in rows]) - base["label"].mean()) < 0.05
    assert all(r["predicted"] == int(r["probability"] > 0.5) for r in rows if abs(r["probability"] - 0.5) > 1e-9)


def model_attributions(spark, sf, rows):
    """Attributions and the base add up to the model's log odds of each binned row."""
    model, data = learning.boosted(spark, sf)
    binned = data.select(*model.binned()).distinct().withColumn("margin", model.margin()).collect()
    margin = {(r["b0"], r["b1"]): r["margin"] for r in binned}
    sums = {(r["b0"], r["b1"]): r["score"] + r["score2"] for r in rows}
    assert set(sums) == set(margin)
    offsets = [margin[k] - sums[k] for k in margin]
    assert max(offsets) - min(offsets) < 1e-9 and sum(r["n"] for r in rows) == data.count()


def model_importance(spark, sf, rows):
    assert {r["feature"] for r in rows} == {"score", "score2"} and all(r["importance"] >= 0 for r in rows)


def model_tuned(spark, sf, rows):
    assert sum(r["best"] for r in rows) == 1 and min(rows, key=lambda r: r["log_loss"])["best"] and all(0 < r["log_loss"] < 1 for r in rows)


def model_validation(spark, sf, rows):
    base = scored(spark, sf)
    test = base[base["day"].astype(str) >= "1996-01-01"]
    got = {r["metric"]: r for r in rows}
    assert math.isclose(got["auc"]["test"], _auc(test["label"].to_numpy(), test["score"].to_numpy()), rel_tol=1e-9)
    assert math.isclose(got["brier"]["test"], ((test["score"] - test["label"]) ** 2).mean(), rel_tol=1e-9)
    assert got["auc"]["passed"] == (got["auc"]["test"] >= 0.6) and got["ks"]["gate"] is None


def scorecard_binning(spark, sf, rows):
    """Edges rise, the rate of bads moves one way, and evidence follows from the counts."""
    p = scored(spark, sf)
    edges = [r["edge"] for r in rows]
    assert edges == sorted(edges)
    which = np.searchsorted(edges, p["score"])
    bad, good = (p["label"] == 1).groupby(which).sum().to_numpy(), (p["label"] == 0).groupby(which).sum().to_numpy()
    rates = bad / (bad + good)
    assert (np.diff(rates) >= 0).all() or (np.diff(rates) <= 0).all()
    for r, a, b in zip(rows, good, bad):
        woe = math.log((a / good.sum()) / (b / bad.sum()))
        assert math.isclose(r["woe"], woe, rel_tol=1e-9) and math.isclose(r["iv"], (a / good.sum() - b / bad.sum()) * woe, rel_tol=1e-9, abs_tol=1e-15)


def model_cox(spark, sf, rows):
    """The coefficient maximises the partial likelihood (Efron or Breslow ties are one within the grid's step)."""
    from granary.operators.panel import survival_subjects

    s = survival_subjects(account_months(spark, sf)).toPandas()
    t, e, x = s["time"].to_numpy(), (s["cause"] == 1).to_numpy(), np.minimum(np.floor(s["balance"].astype(float) / 1e7), 5)
    order = np.argsort(-t, kind="stable")

    def value(beta):
        w = np.exp(beta * x.to_numpy()[order])
        total = np.cumsum(w)
        last = {}
        for i, k in enumerate(t[order]):
            last[k] = total[i]
        return sum(beta * x.iloc[i] - math.log(last[t[i]]) for i in np.flatnonzero(e))

    at = rows[0]["coefficient"]
    assert value(at) >= max(value(at - 0.3), value(at + 0.3))


def bandit_choices(spark, sf, rows):
    a = learning.arms(spark, sf).toPandas()
    models_ = {}
    for arm, part in a.groupby("arm"):
        x = part[["x0", "x1"]].to_numpy()
        inverse = np.linalg.inv(np.eye(2) + x.T @ x)
        models_[arm] = (inverse, inverse @ (x.T @ part["r"].to_numpy()))
    for r, (_, row) in zip(sorted(rows, key=lambda r: r["id"])[::97], list(a.sort_values("id").iterrows())[::97]):
        x = np.array([1.0, row["x1"]])
        bound = {arm: x @ theta + 0.5 * math.sqrt(x @ inverse @ x) for arm, (inverse, theta) in models_.items()}
        assert bound[r["choice"]] >= max(bound.values()) - 1e-9


def document_chunks(spark, sf, rows):
    """Chunks keep every word of a document in order, and stay within the budget unless a table is larger."""
    by = defaultdict(list)
    for r in rows:
        by[r["key"]].append(r)
    for d in table(spark, sf, "documents").collect():
        parts = sorted(by[str(d["doc_id"])], key=lambda r: r["chunk_id"])
        assert " ".join(p["body"] for p in parts).split() == (d["text"] or "").split()
        assert all(p["terms"] == passages.terms(p["body"]) and (p["terms"] <= passages.MAX_TERMS or "|" in p["body"]) for p in parts)


def identity_tokens(spark, sf, rows):
    names = {r["c_custkey"]: r["c_name"] for r in table(spark, sf, "customer").collect()}
    for r in rows:
        n = names[r["c_custkey"]]
        assert r["token"] == hmac.new(b"key of the test tables", b"customer\x00" + n.strip().encode(), hashlib.sha256).hexdigest()[:32]


def plot_overlap(spark, sf, rows):
    """Against the share of a fine grid of points that lie in both shapes."""
    shapes = {r["id"]: [(p["x"], p["y"]) for p in r["p"]] for r in models.plots(spark, sf).collect()}

    def inside(shape, x, y):
        sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(shape, shape[1:] + shape[:1])]
        return np.logical_and.reduce(sides)

    x, y = np.meshgrid(np.linspace(-1, 230, 400), np.linspace(-1, 200, 400))
    for r in sorted(rows, key=lambda r: r["id"])[::17]:
        a = shapes[r["id"]]
        p, q = inside(a, x, y), inside([(u + r["id"] % 40, v) for u, v in a], x, y)
        assert abs((p & q).sum() / (p | q).sum() - r["iou"]) < 0.02


def survival_calibration(spark, sf, rows):
    from granary.operators.panel import survival_subjects

    s = survival_subjects(account_months(spark, sf)).toPandas()
    s["p"] = 1 / (1 + np.floor(s["balance"].astype(float) / 1e7) / 10)
    s = s.sort_values("p", kind="stable")
    at = 0
    for r in sorted(rows, key=lambda r: r["bucket"]):
        part = s.iloc[at : at + r["n"]]
        at += r["n"]
        alive = 1.0
        for t in sorted(part[(part["cause"] == 1) & (part["time"] <= 12)]["time"].unique()):
            alive *= 1 - ((part["time"] == t) & (part["cause"] == 1)).sum() / (part["time"] >= t).sum()
        assert abs(r["predicted"] - part["p"].mean()) < 1e-6 and abs(r["observed"] - alive) < 1e-6
    assert at == len(s)


def loss_beta_regression(spark, sf, rows):
    assert rows and all(v is None or not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)


def model_temperature(spark, sf, rows):
    assert rows and all(v is None or not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)


def scorecard_stepwise(spark, sf, rows):
    assert rows and all(v is None or not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)


def hazard_competing(spark, sf, rows):
    """Mean hazards are probabilities, one row a month."""
    assert rows and all(0 <= r[n] <= 1 for r in rows for n in ("default", "prepaid"))
    assert len({r["months_on_book"] for r in rows}) == len(rows)


def calls_rate_limited(spark, sf, rows):
    """Of a user's allowed calls no 21 lie within a day."""
    at = {r["event_id"]: (r["user_id"], r["ts"]) for r in table(spark, sf, "events").collect()}
    by = defaultdict(list)
    for r in rows:
        if r["allowed"]:
            by[at[r["event_id"]][0]].append(at[r["event_id"]][1])
    for v in by.values():
        v.sort()
        assert all((b - a).total_seconds() >= 86400 for a, b in zip(v, v[20:]))
    assert len(rows) == len(at)
