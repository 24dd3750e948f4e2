"""Further learners: forests, fraud models, tuning, importance, curves, exploration, folds by group, baseline hazards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import boosting as B
from granary.operators.fits import VECTOR, WEIGHT


def random_forest(rows: DataFrame, label: str, features: list[str], trees: int = 100, depth: int = 8, least: int = 3, seed: int = 0):
    """A forest on bootstrap samples, by MLlib; the label holds class numbers from 0."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="keep").transform(rows)
    return RandomForestClassifier(featuresCol=VECTOR, labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed).fit(x)


def class_probabilities(model, rows: DataFrame, features: list[str], id_: str) -> DataFrame:
    """(id, probabilities, predicted) of a fitted classifier."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="keep").transform(rows.select(id_, *features))
    return model.transform(x).select(id_, vector_to_array("probability").alias("probabilities"), F.col("prediction").cast("int").alias("predicted"))


def fraud_model(rows: DataFrame, label: str, features: list[str], monotone: dict[str, int] | None = None, positive_weight: float | None = None, **options) -> B.Model:
    """Boosted trees in which frauds weigh as much as all other rows, or as ``positive_weight`` says."""
    n, pos = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    if not pos or pos == n:
        raise ValueError("a fraud model needs both labels")
    weight = positive_weight if positive_weight is not None else (n - pos) / pos
    return B.fit(rows.withColumn(WEIGHT, F.when(F.col(label) == 1, float(weight)).otherwise(1.0)), label, features, monotone, weight=WEIGHT, **options)


def log_loss(model: B.Model, rows: DataFrame, label: str) -> float:
    p = F.least(F.greatest(model.probability(), F.lit(1e-12)), F.lit(1 - 1e-12))
    binned = rows.select(F.col(label).alias("y"), *model.binned())
    return binned.agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def tuned(rows: DataFrame, validation: DataFrame, label: str, features: list[str], grid: list[dict], monotone: dict[str, int] | None = None) -> tuple[B.Model, dict, list[tuple[dict, float]]]:
    """The model with the least log loss on the validation rows, its setting, and the loss of every setting; ties to the first."""
    if not grid:
        raise ValueError("tuning needs settings to choose from")
    tried = []
    for setting in grid:
        model = B.fit(rows, label, features, monotone, **setting)
        tried.append((model, setting, log_loss(model, validation, label)))
    best = min(tried, key=lambda t: t[2])
    return best[0], best[1], [(s, loss) for _, s, loss in tried]


def importance(model: B.Model, rows: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute Shapley value over all rows; each distinct binned row is explained once a task."""
    names = [f"b{i}" for i in range(len(model.features))]
    counted = rows.select(*model.binned()).groupBy(*names).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        explain = lru_cache(maxsize=None)(lambda row: tuple(B.shapley(model, list(row)).values()))
        for pdf in batches:
            total = [0.0] * len(names)
            for *row, n in pdf[[*names, "n"]].itertuples(index=False):
                for i, v in enumerate(explain(tuple(row))):
                    total[i] += abs(v) * n
            yield pd.DataFrame({"feature": model.features, "total": total, "n": [int(pdf["n"].sum())] * len(names)})

    sums = counted.mapInPandas(run, "feature string, total double, n bigint")
    return sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))


def roc(grouped: DataFrame, points: int = 80) -> DataFrame:
    """(fpr, tpr): the curve over distinct scores downwards, thinned to about ``points``, with both ends."""
    from granary.operators.metrics import down, whole

    tpr = F.sum("pos").over(down()) / F.sum("pos").over(whole())
    fpr = F.sum("neg").over(down()) / F.sum("neg").over(whole())
    place, n = F.row_number().over(whole().orderBy(F.desc("score"))), F.count("*").over(whole())
    c = grouped.select(fpr.alias("fpr"), tpr.alias("tpr"), place.alias("place"), n.alias("n"))
    step = F.greatest(F.lit(1), F.floor((F.col("n") + 1) / points))
    kept = c.filter((F.col("place") % step == 0) | (F.col("place") == F.col("n"))).select("fpr", "tpr")
    return kept.unionByName(grouped.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))


def explored(decision: Column, feasible: Column, seed: str = "explore") -> Column:
    """struct(arm, propensity): one of the feasible arms (array), drawn alike by a keyed hash of the decision; null without any."""
    n = F.size(feasible)
    draw = F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(seed), decision.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    arm = F.get(F.array_sort(feasible), F.pmod(draw, F.greatest(n, F.lit(1))).cast("int"))
    return F.when(n > 0, F.struct(arm.alias("arm"), (1 / n).alias("propensity")))


def logged(decisions: DataFrame) -> DataFrame:
    """Bandit decisions as a log for off-policy estimates: taken, target, propensity, reward, q_target, q_taken; decisions without a propensity fail the run."""
    p = F.when(F.col("propensity") > 0, F.col("propensity")).otherwise(F.raise_error(F.lit("a logged decision needs its propensity")).cast("double"))
    return decisions.select(F.col("arm").alias("taken"), F.col("policy_arm").alias("target"), p.alias("propensity"), F.col("reward").cast("double").alias("reward"), "q_target", "q_taken")


def grouped_out_of_fold(rows: DataFrame, features: list[str], id_: str, group: Column, label: str = "label", **options) -> DataFrame:
    """(id, label, score): every group (a month, say) is scored by boosted trees of all others. Groups are few."""
    marked = rows.withColumn("group_", group)
    out = None
    for g in [r[0] for r in marked.select("group_").distinct().orderBy("group_").collect()]:
        model = B.fit(marked.filter(~F.col("group_").eqNullSafe(F.lit(g))), label, features, **options)
        held = marked.filter(F.col("group_").eqNullSafe(F.lit(g))).select(id_, label, *model.binned()).select(id_, label, model.probability().alias("score"))
        out = held if out is None else out.unionByName(held)
    return out


def baseline_hazard(rows: DataFrame, beta: dict[str, float], time: str, event: str) -> DataFrame:
    """Breslow's cumulative baseline hazard: (time, events, hazard, cumulative). Rows are person-periods; those of a period are its risk set.

    Sums are scaled by the greatest linear predictor of a period, so that they cannot overflow.
    """
    eta = sum([F.col(f) * float(b) for f, b in beta.items()], F.lit(0.0))
    x = rows.select(F.col(time).alias("time"), F.col(event).alias("event"), eta.alias("eta"))
    top = x.groupBy("time").agg(F.max("eta").alias("top"))
    g = x.join(F.broadcast(top), "time").groupBy("time", "top").agg(F.sum((F.col("event") == 1).cast("int")).alias("events"), F.sum(F.exp(F.col("eta") - F.col("top"))).alias("total"))
    step = F.when(F.col("events") > 0, F.exp(F.log("events") - F.col("top") - F.log("total"))).otherwise(0.0)
    past = Window.partitionBy(F.lit(0)).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("time", "events", step.alias("hazard")).withColumn("cumulative", F.sum("hazard").over(past))


def selection_gap(accepted: DataFrame, rejected: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """One row: stability index of the rejected against the accepted, and both means."""
    from granary.operators import metrics as M

    psi = M.stability(accepted, rejected, M.quantile_edges(accepted, bins, score), score)
    means = accepted.agg(F.avg(score).alias("accepted_mean")).crossJoin(F.broadcast(rejected.agg(F.avg(score).alias("rejected_mean"))))
    return psi.crossJoin(F.broadcast(means))


def validation_report(train: DataFrame, test: DataFrame, gates: dict[str, tuple[str, float]], score: str = "score", label: str = "label") -> DataFrame:
    """(metric, train, test, gate, passed): discrimination and calibration of both samples, their stability, and the gates on the test.

    ``gates``: metric -> (at_least or at_most, limit); a metric without a gate has null there.
    """
    from granary.operators import metrics as M

    def measures(rows: DataFrame) -> DataFrame:
        one = M.auc(M.by_score(rows, score, label)).select("auc", "gini", "ks").crossJoin(F.broadcast(M.point_metrics(rows, score, label)))
        return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("auc", "gini", "ks", "brier", "log_loss")])).alias("x")).select("x.*")

    both = measures(test).select("metric", F.col("value").alias("test")).join(measures(train).select("metric", F.col("value").alias("train")), "metric", "left")
    psi = M.stability(train, test, M.quantile_edges(train, 10, score), score).select(F.lit("psi").alias("metric"), F.col("psi").alias("test"), F.lit(None).cast("double").alias("train"))
    x = both.unionByName(psi)
    gate = F.coalesce(*[F.when(F.col("metric") == m, F.lit(float(v))) for m, (_, v) in gates.items()], F.lit(None).cast("double"))
    keeps = F.coalesce(*[F.when(F.col("metric") == m, (F.col("test") >= v) if side == "at_least" else (F.col("test") <= v)) for m, (side, v) in gates.items()], F.lit(None).cast("boolean"))
    return x.select("metric", "train", "test", gate.alias("gate"), keeps.alias("passed"))
