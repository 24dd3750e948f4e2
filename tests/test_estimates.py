"""Fits and rules on known answers and on nulls, ties and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.config import Pending, Unratified
from granary.functions import special
from granary.operators import estimates as E
from granary.operators import governance as V
from granary.operators import history as H
from granary.operators import land as L
from granary.operators import metrics as M
from granary.operators import survival as S


def test_special_functions(spark):
    xs = [1e-3, 0.2, 0.9, 1.0, 2.5, 17.0, 300.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.log_gamma(F.col("x")).alias("g"), special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).collect()
    h = 1e-5
    for r in rows:
        assert math.isclose(r.g, math.lgamma(r.x), abs_tol=1e-9, rel_tol=1e-9)
        if r.x > 0.1:
            assert math.isclose(r.d, (math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel_tol=1e-4, abs_tol=1e-6)
    assert math.isclose(rows[3].t, math.pi**2 / 6, rel_tol=1e-9)


def test_beta_regression_recovers(spark):
    g = np.random.default_rng(1)
    x = g.uniform(-1, 1, 4000)
    mu = 1 / (1 + np.exp(-(0.4 + 1.2 * x)))
    y = g.beta(mu * 8, (1 - mu) * 8)
    beta, phi = E.beta_regression(spark.createDataFrame([*map(tuple, zip(x.tolist(), y.tolist()))] + [(None, 0.5)], "x double, y double"), "y", ["x"])
    assert abs(beta[0] - 0.4) < 0.05 and abs(beta[1] - 1.2) < 0.08 and abs(phi - 8) < 0.6


def test_temperature_recovers(spark):
    g = np.random.default_rng(2)
    z = g.normal(size=(3000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(g.choice(3, p=q)) for q in p]
    sharp = np.exp(2.5 * z) / np.exp(2.5 * z).sum(1, keepdims=True)
    t = E.temperature(spark.createDataFrame(list(zip(sharp.tolist(), y)), "p array<double>, y int"), "p", "y")
    assert abs(t - 2.5) < 0.25
    with pytest.raises(ValueError):
        E.temperature(spark.createDataFrame([], "p array<double>, y int"), "p", "y")


def test_stepwise_drops_wrong_signs(spark):
    g = np.random.default_rng(3)
    good = g.normal(size=(2000, 3))
    y = (g.uniform(size=2000) < 1 / (1 + np.exp(good.sum(1)))).astype(int)
    bad = -good[:, :1] * 0.2 + y[:, None] * 2 + g.normal(size=(2000, 1))
    rows = spark.createDataFrame([(int(l), *map(float, a), float(b)) for l, a, b in zip(y, good, bad[:, 0])], "label int, a double, b double, c double, w double")
    s = E.stepwise(rows, ["w", "a", "b", "c"], 3, minimum=2)
    assert s.settled and s.features == ["a", "b", "c"] and s.log[0][0] == "w"


def test_incidence_scales_and_orders(spark):
    h = spark.createDataFrame([(1, 2, 0.5, None), (1, 1, 0.9, 0.6), (2, 1, 0.0, 0.0)], "k int, t int, a double, b double")
    r = {(x.k, x.t): x for x in E.incidence(h, "k", "t", "a", "b").collect()}
    assert math.isclose(r[1, 1].cif1, 0.6) and math.isclose(r[1, 1].cif2, 0.4) and r[1, 2].cif1 == r[1, 1].cif1 and abs(r[1, 2].survival) < 1e-12 and r[2, 1].survival == 1


def test_histories_nulls_and_empty(spark):
    kind = "applicant int, status string, days int, days_overdue int, max_overdue double, debt double, credit double, prolonged int, overdue double"
    b = H.bureau(spark.createDataFrame([(1, "Active", -10, 3, None, None, None, 0, None), (None, "Closed", -1, 0, 1.0, 1.0, 1.0, 0, 1.0)], kind)).collect()
    assert len(b) == 1 and b[0].debt_ratio is None and b[0].debt == 0 and b[0].recent == 1
    assert H.bureau(spark.createDataFrame([], kind)).count() == 0
    m = H.repayments(spark.createDataFrame([(1, 0, 900, 0, "Active"), (2, -1, None, None, "Completed"), (3, None, 5, 5, "Active")], "applicant int, month int, dpd int, dpd_tolerated int, status string")).collect()
    assert [(r.applicant, r.max_dpd, r.mean_dpd, r.completed) for r in m] == [(2, 0.0, 0.0, 1)]


def test_suitability_needs_applicants(spark):
    r = spark.createDataFrame([(1, "sowing", 10.0)], "borrower int, stage string, emi double")
    empty = spark.createDataFrame([], "borrower int, segment string, stressed_cash_flow double")
    with pytest.raises(Exception, match="no applicant"):
        V.suitability(r, empty).collect()
    known = spark.createDataFrame([(1, "agri", None)], "borrower int, segment string, stressed_cash_flow double")
    assert [x.check for x in V.suitability(r, known).collect()] == ["no_stressed_cash_flow"]


def test_retirement_needs_a_floor(spark):
    with pytest.raises(Unratified):
        V.retirement(F.lit(0.1), Pending("precision floor"))
    r = spark.range(1).select(V.retirement(F.lit(0.1), 0.2).alias("low"), V.retirement(F.lit(None).cast("double"), 0.2).alias("quiet")).first()
    assert r.low and not r.quiet


def test_compatibility(spark):
    kind = "record string, field string, types array<string>, has_default boolean"
    old = spark.createDataFrame([("r", "a", ["int"], False), ("r", "b", ["double"], True), ("r", "c", ["string"], False)], kind)
    new = spark.createDataFrame([("r", "a", ["long", "null"], False), ("r", "b", ["int"], False), ("r", "d", ["int"], None)], kind)
    got = {(r.field, r.issue, r.severity) for r in V.compatibility(old, new).collect()}
    assert got == {("b", "type_changed", "breaking"), ("b", "default_removed", "breaking"), ("c", "removed", "warning"), ("d", "added_without_default", "breaking")}


def test_snap_takes_best_or_leaves(spark):
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    shape = "array<struct<x:double,y:double>>"
    plots = spark.createDataFrame([(1, box(1.0, 0.0, 10.0)), (2, box(500.0, 500.0, 10.0)), (3, box(6.0, 0.0, 10.0))], f"id int, p {shape}")
    parcels = spark.createDataFrame([(7, box(0.0, 0.0, 10.0)), (8, box(10.0, 0.0, 10.0)), (9, box(0.0, 0.0, 10.0))], f"parcel int, q {shape}")
    r = {x.id: x for x in L.snapped(plots, parcels, 0.6, 10.0).collect()}
    assert r[1].parcel == 7 and r[1].snapped and not r[2].snapped and not r[3].snapped and [tuple(v) for v in r[3].boundary] == box(6.0, 0.0, 10.0)


def test_tiles_of_other_sizes_are_left_out(spark):
    t = spark.createDataFrame([(1, [1.0] * 9), (2, [1.0]), (3, None)], "tile int, pixels array<double>")
    r = L.tile_features(t, 3, (1,)).collect()
    assert len(r) == 9 and all(x.mean_1 == 1 and x.std_1 == 0 for x in r)


def test_uplift_area_against_rows(spark):
    g = np.random.default_rng(4)
    rows = [(i, float(g.integers(5)), int(g.integers(2)), int(g.integers(2))) for i in range(300)]
    inc, n1, y1, n0, y0 = [], 0, 0, 0, 0
    for _, _, t, o in sorted(rows, key=lambda r: (-r[1], r[0])):
        n1, y1, n0, y0 = n1 + t, y1 + t * o, n0 + 1 - t, y0 + (1 - t) * o
        inc.append(y1 - (y0 * n1 / n0 if n0 else 0))
    want = (sum((a + b) / 2 for a, b in zip(inc, inc[1:])) - sum(inc[-1] * k / 300 for k in range(1, 300))) / 300
    df = spark.createDataFrame(rows, "id int, score double, treated int, outcome int")
    for chunk in (7, 1 << 16):
        assert math.isclose(M.uplift_area(df, chunk=chunk).first().qini, want, rel_tol=1e-9)
    assert M.uplift_area(df.limit(0)).first().qini is None


def test_time_auc_and_calibration_against_rows(spark):
    g = np.random.default_rng(5)
    rows = [(int(g.integers(1, 12)), int(g.integers(3)), float(g.integers(6))) for _ in range(250)]
    df = spark.createDataFrame(rows, "time int, cause int, risk double")

    def km(members, hit, before):
        s = 1.0
        for t in sorted({m[0] for m in members}):
            if t <= before:
                s *= 1 - sum(m[0] == t and hit(m[1]) for m in members) / sum(m[0] >= t for m in members)
        return s

    num = den = 0.0
    controls = [r for r in rows if r[0] > 6]
    for t, c, risk in rows:
        if c == 1 and t <= 6 and (gt := km(rows, lambda k: k == 0, t - 1)) > 0:
            num += sum((risk > o[2]) + (risk == o[2]) / 2 for o in controls) / gt
            den += len(controls) / gt
    assert math.isclose(S.time_dependent_auc(df, F.col("risk"), [6]).first().auc, num / den, rel_tol=1e-9)
    assert S.time_dependent_auc(df, F.col("risk"), [99]).first().auc is None
    got = S.calibration_at(df, 1 - F.col("risk") / 10, 6, 3).orderBy("bucket").collect()
    assert sum(r.n for r in got) == 250
    order = sorted(rows, key=lambda r: 1 - r[2] / 10)
    start = 0
    for r in got:
        members = order[start : start + r.n]
        assert math.isclose(r.observed, km(members, lambda k: k == 1, 6), rel_tol=1e-9)
        start += r.n


def test_trigger_rules(spark):
    import datetime

    from granary.operators import triggers as T

    plots = spark.createDataFrame([(1, None), (2, True), (3, False)], "plot int, sowing_observed boolean")
    day = datetime.date(2024, 7, 1)
    assert {r.subject for r in T.non_sowing(plots, day, day).collect()} == {"1", "3"}
    assert T.non_sowing(plots, day, day + datetime.timedelta(1)).count() == 0
    with pytest.raises(Unratified):
        T.non_sowing(plots, day, Pending("sowing cutoff"))
    wrong = spark.createDataFrame([(1, "2024-01-01", 12, -3.0)], "district int, observed string, timescale int, value double")
    with pytest.raises(Exception, match="over 3 months"):
        T.district_drought(wrong, -1.0).collect()
    none = spark.createDataFrame([], "defaulted date, flagged date")
    assert T.lead_summary(none, 45).first().defaults == 0


def test_register_is_idempotent(spark):
    from granary.operators import triggers as T

    kind = "key string, content string"
    old = spark.createDataFrame([("a", "x"), ("n", None)], kind)
    assert T.registered(old, spark.createDataFrame([("a", "x"), ("b", "y"), ("n", None)], kind)).count() == 3
    with pytest.raises(Exception, match="other content"):
        T.registered(old, spark.createDataFrame([("a", "z")], kind)).collect()


def test_policy_documents_and_reports(spark, tmp_path):
    from granary.sources import policies as P

    (tmp_path / "good.json").write_text('[{"table": "decisions", "kind": "decision", "years": 5, "grounds": "law"}, {"table": "t", "years": 9}]')
    (tmp_path / "bad.json").write_text("{no")
    good, bad = P.documents(spark, str(tmp_path), P.RETENTION, ("table", "kind", "years"))
    assert [r.table for r in good.filter(P.too_short(F.col("years"), F.col("kind"))).collect()] == ["decisions"]
    assert sorted(p for r in bad.collect() for p in r.problems) == ["kind_missing", "not_json"]
    P.write_report(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_drift_is_the_recursion(spark):
    from granary.operators import series as R

    g = np.random.default_rng(6)
    rows = [(1, i, 0.2, int(g.integers(9)), 20) for i in range(40)]
    got = R.calibration_drift(spark.createDataFrame(rows + [(1, 99, 0.2, 0, 0)], "series int, moment int, expected double, bads int, accounts int"), 0.3, 2.0).orderBy("moment").collect()
    up = low = 0.0
    for r, (_, _, e, b, n) in zip(got, rows, strict=True):
        z = (b / n - e) / math.sqrt(e * (1 - e) / n)
        up, low = max(0, up + z - 0.3), max(0, low - z - 0.3)
        assert math.isclose(r.upper, up, abs_tol=1e-9) and math.isclose(r.lower, low, abs_tol=1e-9)
