"""Model fits: sums on the cluster, small solves on the driver, or MLlib."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import kernels as K
from granary.operators.metrics import by_score

#: Distinct scores up to which a curve is fitted on the driver.
CURVE = 100_000

#: Columns added for MLlib; named so that they do not hide a feature.
VECTOR, WEIGHT = "__vector", "__weight"


def grouped_scores(rows: DataFrame, score: str = "score", label: str = "label", digits: int | None = None) -> pd.DataFrame:
    """Counts and positives per distinct score, ascending; at most ``CURVE`` of them, whatever the number of rows.

    A score of finer steps is rounded by the caller's choice of ``digits``, never by itself.
    """
    g = by_score(rows if digits is None else rows.withColumn(score, F.round(score, digits)), score, label)
    head = g.limit(CURVE + 1).toPandas()
    if len(head) > CURVE:
        raise ValueError(f"more than {CURVE} distinct scores: name the digits to round them to")
    return head.sort_values("score")


def isotonic_curve(rows: DataFrame, score: str = "score", label: str = "label", digits: int | None = None) -> pd.DataFrame:
    """(score, fitted): the calibrated probability at each distinct score."""
    g = grouped_scores(rows, score, label, digits)
    return pd.DataFrame({"score": g["score"], "fitted": K.isotonic((g["pos"] / g["n"]).to_numpy(float), g["n"].to_numpy(float))})


def platt_coefficients(rows: DataFrame, score: str = "score", label: str = "label", digits: int | None = None) -> tuple[float, float]:
    g = grouped_scores(rows, score, label, digits)
    return K.platt(g["score"].to_numpy(float), g["pos"].to_numpy(float), g["n"].to_numpy(float))


def calibration_bins(rows: DataFrame, bins: int = 10, score: str = "score", label: str = "label", digits: int | None = None) -> pd.DataFrame:
    """Mean score and rate in equal bins extended through ties, and the calibration error's terms."""
    g = grouped_scores(rows, score, label, digits)
    g["bin"] = K.tie_extended_bins(g["score"].to_numpy(), g["n"].to_numpy(), bins)
    g["s"] = g["score"] * g["n"]
    out = g.groupby("bin", as_index=False).agg(n=("n", "sum"), pos=("pos", "sum"), s=("s", "sum"))
    return pd.DataFrame({"bin": out["bin"], "n": out["n"], "predicted": out["s"] / out["n"], "observed": out["pos"] / out["n"]})


def least_squares(rows: DataFrame, target: str, factors: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (intercept first), standard errors and R squared, from one pass of sums."""
    names = ["1.0", *factors]
    sums = [F.sum(F.expr(f"({a}) * ({b})")).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, target])]
    r = rows.agg(*sums, F.sum(F.expr(f"({target}) * ({target})")).alias("yy")).first()
    k = len(names)
    xx = np.array([[r[f"s{i}_{j}"] for j in range(k)] for i in range(k)], float)
    xy = np.array([r[f"s{i}_{k}"] for i in range(k)], float)
    n = xx[0, 0]
    beta = np.linalg.solve(xx, xy)
    residual = r["yy"] - beta @ xy
    error = np.sqrt(np.diag(np.linalg.inv(xx)) * residual / (n - k))
    return beta, error, float(1 - residual / (r["yy"] - xy[0] ** 2 / n))


def isolation_forest(rows: DataFrame, features: list[str], trees: int = 50, sample: int = 256, seed: int = 0) -> list:
    """Trees on samples drawn by a keyed hash of the features; each tree is grown in a task of its own."""
    n = rows.count()
    rate = min(1.0, 2.0 * sample / max(n, 1))
    x = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "tree", *features), F.lit(1 << 30)) < int(rate * (1 << 30))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        g = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        v = pdf[features].to_numpy(float)
        v = v[np.lexsort(v.T)]
        v = v[g.permutation(len(v))[:sample]]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "model": [pickle.dumps(K.isolation_tree(v, g, 8))], "n": [len(v)]})

    import pickle

    grown = x.filter(draw).groupBy("tree").applyInPandas(grow, "tree int, model binary, n bigint").orderBy("tree").collect()
    return [(pickle.loads(r["model"]), r["n"]) for r in grown]


def anomaly_scores(rows: DataFrame, forest: list, features: list[str], id_: str) -> DataFrame:
    """2 ** -(mean depth / expected depth) of every row."""
    norm = np.mean([K.path_length(n) for _, n in forest])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            depth = np.mean([K.isolation_depth(t, x) for t, _ in forest], axis=0) if len(x) else np.zeros(0)
            yield pd.DataFrame({id_: pdf[id_], "anomaly": 2.0 ** (-depth / norm)})

    slim = rows.select(id_, *[F.col(f).cast("double").alias(f) for f in features])
    return slim.mapInPandas(score, f"{id_} {slim.schema[id_].dataType.simpleString()}, anomaly double")


def logistic(rows: DataFrame, features: list[str], label: str = "label", l2: float = 1e-4):
    """Standardised logistic regression by MLlib; balanced weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, pos = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    weight = F.when(F.col(label) == 1, n / (2.0 * max(pos, 1.0))).otherwise(n / (2.0 * max(n - pos, 1.0)))
    x = VectorAssembler(inputCols=features, outputCol=VECTOR).transform(rows.withColumn(WEIGHT, weight))
    return LogisticRegression(featuresCol=VECTOR, labelCol=label, weightCol=WEIGHT, regParam=l2, standardization=True).fit(x)


def out_of_fold(rows: DataFrame, features: list[str], id_: str, label: str = "label", folds: int = 3) -> DataFrame:
    """Predictions for each fold from a model of the others; folds by a hash of the id, whatever the partitions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    fold = F.pmod(F.xxhash64(id_), F.lit(folds))
    out = None
    for k in range(folds):
        model = logistic(rows.filter(fold != k), features, label)
        held = VectorAssembler(inputCols=features, outputCol=VECTOR).transform(rows.filter(fold == k))
        part = model.transform(held).select(id_, label, vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
