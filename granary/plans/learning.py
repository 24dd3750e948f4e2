"""Queries over boosted trees, binning, bandits, chunks and polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import passages
from granary.operators import boosting as B
from granary.operators.fits import grouped_scores
from granary.plans.models import plots
from granary.plans.registry import query
from granary.plans.scoring import rounded
from granary.sources.tables import SCORED_SQL as SC
from granary.sources.tables import scored_rows, table

FEATURES = ["score", "score2"]


def boosted(spark: SparkSession, sf: str) -> tuple[B.Model, DataFrame]:
    rows = scored_rows(spark, sf)
    return B.fit(rows, "label", FEATURES, {"score": 1}, trees=5), rows


@query()
def model_boosted(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = boosted(spark, sf)
    return rows.select("id", "label", *model.binned()).select("id", "label", model.probability().alias("probability"))


@query()
def model_attributions(spark: SparkSession, sf: str) -> DataFrame:
    """Exact Shapley values of each distinct binned row, which are few, with the rows that each stands for."""
    model, rows = boosted(spark, sf)
    g = rows.select(*model.binned()).groupBy("b0", "b1").agg(F.count("*").alias("n")).collect()
    out = [(r["b0"], r["b1"], r["n"], *(float(v) for v in B.shapley(model, [r["b0"], r["b1"]]).values())) for r in g]
    return spark.createDataFrame(out, "b0 int, b1 int, n bigint, score double, score2 double")


@query()
def scorecard_binning(spark: SparkSession, sf: str) -> DataFrame:
    g = grouped_scores(scored_rows(spark, sf))
    bins = B.fit_binning(g["score"].to_numpy(float), g["neg"].to_numpy(float), g["pos"].to_numpy(float))
    return spark.createDataFrame(bins, "edge double, woe double, iv double")


_ARMS = f"""{SC}, lg AS (SELECT 'arm' || (id % 3) AS arm, 1.0 AS x0, score AS x1, CAST(label AS DOUBLE) AS r FROM scored)
SELECT arm, count(*) AS n, round(sum(x0 * x0) + 1, 4) AS a00, round(sum(x0 * x1), 4) AS a01, round(sum(x1 * x1) + 1, 4) AS a11, round(sum(r * x0), 4) AS b0, round(sum(r * x1), 4) AS b1 FROM lg GROUP BY 1"""


def arms(spark: SparkSession, sf: str) -> DataFrame:
    return scored_rows(spark, sf).select("id", F.concat(F.lit("arm"), (F.col("id") % 3).cast("string")).alias("arm"), F.lit(1.0).alias("x0"), F.col("score").alias("x1"), F.col("label").cast("double").alias("r"))


@query(_ARMS)
def bandit_updates(spark: SparkSession, sf: str) -> DataFrame:
    a = arms(spark, sf)
    n = {r["arm"]: r["n"] for r in a.groupBy("arm").agg(F.count("*").alias("n")).collect()}
    rows = [(k, n[k], round(float(m[0, 0]), 4), round(float(m[0, 1]), 4), round(float(m[1, 1]), 4), round(float(b[0]), 4), round(float(b[1]), 4)) for k, (m, b) in B.bandit_sums(a, "arm", ["x0", "x1"], "r").items()]
    return spark.createDataFrame(rows, "arm string, n bigint, a00 double, a01 double, a11 double, b0 double, b1 double")


@query()
def bandit_choices(spark: SparkSession, sf: str) -> DataFrame:
    a = arms(spark, sf)
    return a.select("id", B.upper_confidence(B.bandit_sums(a, "arm", ["x0", "x1"], "r"), ["x0", "x1"], 0.5).alias("choice"))


@query()
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return passages.chunked(table(spark, sf, "documents"), "doc_id", "text")


@query()
def identity_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", passages.tokenised(F.col("c_name"), b"key of the test tables", "customer").alias("token"))


@query()
def plot_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of each plot with the same plot moved by its id."""
    @F.pandas_udf("double")
    def iou(xs: pd.Series, ys: pd.Series, by: pd.Series) -> pd.Series:
        out = []
        for x, y, d in zip(xs, ys, by, strict=True):
            a = list(zip(x, y, strict=True))
            out.append(passages.overlap(a, [(p + d, q) for p, q in a]))
        return pd.Series(out, dtype=np.float64)

    p = plots(spark, sf)
    axis = lambda n: F.transform("p", lambda v: v[n])
    return rounded(p.select("id", iou(axis("x"), axis("y"), (F.col("id") % 40).cast("double")).alias("iou")), "iou")
