"""Boosting, binning, bandits, passages and polygons on known answers."""

import hashlib
import hmac

import numpy as np
from pyspark.sql import functions as F

from granary.functions import passages
from granary.operators import boosting as B


def test_boosting_is_monotone_and_learns(spark):
    g = np.random.default_rng(0)
    x, z = g.uniform(0, 1, 4000), g.uniform(0, 1, 4000)
    y = (g.uniform(0, 1, 4000) < 1 / (1 + np.exp(-(6 * x - 3 + np.sin(40 * x))))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, x, z)], "y int, x double, z double")
    model = B.fit(df, "y", ["x", "z"], {"x": 1}, trees=5)
    rows = df.select("y", "x", "z", *model.binned()).select("y", "x", "b0", "b1", model.margin().alias("m")).collect()
    fixed = {}
    for r in rows:
        fixed.setdefault(r["b1"], []).append((r["b0"], r["m"]))
    assert all(a[1] <= b[1] + 1e-9 for v in fixed.values() for a, b in zip(sorted(v), sorted(v)[1:]) if a[0] < b[0])
    m = np.array([r["m"] for r in rows])
    lab = np.array([r["y"] for r in rows])
    order = m.argsort().argsort()
    auc = (order[lab == 1].sum() - lab.sum() * (lab.sum() - 1) / 2) / (lab.sum() * (1 - lab).sum())
    assert auc > 0.75
    r = rows[0]
    parts = B.shapley(model, [r["b0"], r["b1"]])
    base = model.base + model.rate * sum(B.expectation(t, [0, 0], frozenset()) for t in model.trees)
    assert abs(base + sum(parts.values()) - r["m"]) < 1e-9


def test_binning_is_monotone():
    values = np.arange(100.0)
    bads = np.round(5 + values / 10)
    bins = B.fit_binning(values, 20 - bads + 5, bads)
    woe = [b[1] for b in bins]
    assert len(bins) > 3 and woe == sorted(woe, reverse=True) and all(b[2] >= 0 for b in bins)


def test_bandit_prefers_the_better_arm(spark):
    g = np.random.default_rng(1)
    log = [(a, 1.0, float(x), float(a == "b") + 0.1 * g.normal()) for a in "ab" for x in g.uniform(0, 1, 50)]
    sums = B.bandit_sums(spark.createDataFrame(log, "arm string, x0 double, x1 double, r double"), "arm", ["x0", "x1"], "r")
    got = spark.createDataFrame([(1.0, 0.3)], "x0 double, x1 double").select(B.upper_confidence(sums, ["x0", "x1"], 0.1)).first()[0]
    assert got == "b"


def test_chunks_keep_every_word_and_the_budget(spark):
    body = " ".join(f"word{i}." for i in range(50))
    text = f"# One\n{body}\n\n## Two\n| a | b |\n| 1 | 2 |\n\n- x\n- y\n\n{body}"
    found = passages.chunks("d", text, 5, 20)
    assert [p for _, p, _, _ in found][0] == "One" and found[-1][1] == "One > Two"
    assert " ".join(b for _, _, b, _ in found).split() == text.split()
    assert all(n <= 20 for *_, n in found)
    df = spark.createDataFrame([("d", text), ("e", None)], "k string, t string")
    assert passages.chunked(df, "k", "t", 5, 20).count() == len(found)


def test_answers_need_citations():
    text = "Dr. Rao says the rate is 9.5% [doc#1]. Fees are 200. It began in 2019. See the 3 rules. [doc#2] Bye."
    kept, gone = passages.checked(text, {"doc#1", "doc#2"})
    assert kept == "Dr. Rao says the rate is 9.5% [doc#1]. It began in 2019. See the 3 rules. [doc#2] Bye." and gone == 1


def test_tokens(spark):
    got = spark.createDataFrame([(" a ",), (None,)], "v string").select(passages.tokenised(F.col("v"), b"k", "d")).collect()
    assert got[0][0] == hmac.new(b"k", b"d\x00a", hashlib.sha256).hexdigest()[:32] and got[1][0] is None


def test_overlap():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert passages.overlap(square, square) == 1 and abs(passages.overlap(square, [(x + 1, y) for x, y in square]) - 1 / 3) < 1e-12
    assert passages.overlap(square, [(x + 5, y) for x, y in square]) == 0
