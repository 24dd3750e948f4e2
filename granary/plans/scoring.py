"""Metric queries over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import credit
from granary.operators import metrics as M
from granary.plans.registry import query
from granary.sources.tables import SCORED_SQL as SC
from granary.sources.tables import scored_rows, table

G = f"{SC}, g AS (SELECT score, count(*) AS n, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1)"
UP, DOWN = "(ORDER BY score ROWS UNBOUNDED PRECEDING)", "(ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query(f"""{G}, w AS (SELECT n, pos, neg, pos * (sum(neg) OVER {UP} - neg + neg / 2.0) AS w, abs(sum(pos) OVER {UP} / CAST(sum(pos) OVER () AS DOUBLE) - sum(neg) OVER {UP} / CAST(sum(neg) OVER () AS DOUBLE)) AS gap FROM g)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(sum(w) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) AS auc, round((2 * sum(w) / CAST(sum(pos) * sum(neg) AS DOUBLE) - 1) * 100, 6) AS gini, round(max(gap), 6) AS ks FROM w""")
def metric_discrimination(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.auc(M.by_score(scored_rows(spark, sf))), "auc", "gini", "ks")


@query(f"""{G} SELECT round(score, 6) AS score, round(sum(pos) OVER {DOWN} / CAST(sum(n) OVER {DOWN} AS DOUBLE), 6) AS precision, round(sum(pos) OVER {DOWN} / CAST(sum(pos) OVER () AS DOUBLE), 6) AS recall FROM g""")
def metric_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.precision_recall(M.by_score(scored_rows(spark, sf))), "score", "precision", "recall")


@query(f"""{G}, t AS (SELECT pos / CAST(sum(pos) OVER () AS DOUBLE) * sum(pos) OVER {DOWN} / sum(n) OVER {DOWN} AS t FROM g) SELECT round(sum(t), 6) AS average_precision FROM t""")
def metric_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.average_precision(M.by_score(scored_rows(spark, sf))), "average_precision")


@query(f"""{SC} SELECT round(avg(power(score - label, 2)), 6) AS brier, round(avg(-CASE WHEN label = 1 THEN ln(least(greatest(score, 1e-12), 1 - 1e-12)) ELSE ln(1 - least(greatest(score, 1e-12), 1 - 1e-12)) END), 6) AS log_loss FROM scored""")
def metric_brier_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.point_metrics(scored_rows(spark, sf)), "brier", "log_loss")


@query(f"""{SC}, k AS (SELECT CAST(greatest(1, round_even(0.01 * count(*), 0)) AS BIGINT) AS k, sum(label) AS p FROM scored), t AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rn FROM scored)
SELECT count(*) AS alerts, CAST(sum(label) AS BIGINT) AS hits, round(sum(label) / CAST(count(*) AS DOUBLE), 6) AS precision, round(sum(label) / CAST(max(p) AS DOUBLE), 6) AS recall FROM t, k WHERE rn <= k""")
def metric_alert_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.alert_rate(scored_rows(spark, sf), 0.01, [F.desc("score"), F.col("id")]), "precision", "recall")


@query(f"""{SC}, ref AS (SELECT score FROM scored WHERE segment = 'F'), cur AS (SELECT score FROM scored WHERE segment = 'O'),
o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM ref),
e AS (SELECT DISTINCT score AS edge FROM o, range(1, 10) r(k) WHERE i = (k * n) // 10),
bins AS (SELECT unnest(range(0, (SELECT count(*) + 1 FROM e))) AS bin),
a AS (SELECT (SELECT count(*) FROM e WHERE edge <= score) AS bin FROM cur), b AS (SELECT (SELECT count(*) FROM e WHERE edge <= score) AS bin FROM ref),
s AS (SELECT bin, greatest((SELECT count(*) FROM a WHERE a.bin = bins.bin) / CAST((SELECT count(*) FROM a) AS DOUBLE), 1e-6) AS a, greatest((SELECT count(*) FROM b WHERE b.bin = bins.bin) / CAST((SELECT count(*) FROM b) AS DOUBLE), 1e-6) AS e FROM bins)
SELECT round(sum((a - e) * ln(a / e)), 6) AS psi, CASE WHEN sum((a - e) * ln(a / e)) > 0.25 THEN 'act' WHEN sum((a - e) * ln(a / e)) > 0.1 THEN 'alert' ELSE 'pass' END AS verdict FROM s""")
def metric_stability(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    ref, cur = rows.filter("segment = 'F'"), rows.filter("segment = 'O'")
    out = M.stability(ref, cur, M.quantile_edges(ref, 10))
    return rounded(out.withColumn("verdict", M.stability_verdict(F.col("psi"))), "psi")


@query(f"""{SC}, x AS (SELECT segment, score < 0.5 AS a, score2 < 0.5 AS b, label AS y FROM scored),
c AS (SELECT segment, count(*) AS n, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND b) AS swap_in, count(*) FILTER (a AND NOT b) AS swap_out, count(*) FILTER (NOT a AND NOT b) AS neither,
 count(*) FILTER (NOT a AND b AND y = 1) AS swap_in_bad, count(*) FILTER (a AND NOT b AND y = 1) AS swap_out_bad FROM x GROUP BY 1)
SELECT *, round((swap_out / CAST(sum(swap_out) OVER () AS DOUBLE)) / (n / CAST(sum(n) OVER () AS DOUBLE)), 6) AS concentration FROM c""")
def metric_swap_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.swap_sets(scored_rows(spark, sf), F.col("score") < 0.5, F.col("score2") < 0.5), "concentration")


RATES = f"""{SC}, r AS (SELECT segment AS g, count(*) AS n, count(*) FILTER (score < 0.5) / CAST(count(*) AS DOUBLE) AS selection, count(*) FILTER (score < 0.5 AND label = 0) / CAST(count(*) FILTER (label = 0) AS DOUBLE) AS tpr,
 count(*) FILTER (score < 0.5 AND label = 1) / CAST(count(*) FILTER (label = 1) AS DOUBLE) AS fpr FROM scored GROUP BY 1)"""


@query(f"{RATES} SELECT g, n, round(selection, 6) AS selection, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r")
def fairness_group_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.group_rates(scored_rows(spark, sf), "segment", (F.col("score") >= 0.5).cast("int")), "selection", "tpr", "fpr")


@query(f"{RATES} SELECT round(max(selection) - min(selection), 6) AS dp_difference, round(min(selection) / max(selection), 6) AS dp_ratio, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS eo_difference, round(max(tpr) - min(tpr), 6) AS opportunity_difference FROM r")
def fairness_disparities(spark: SparkSession, sf: str) -> DataFrame:
    rates = M.group_rates(scored_rows(spark, sf), "segment", (F.col("score") >= 0.5).cast("int"))
    return rounded(M.disparities(rates), "dp_difference", "dp_ratio", "eo_difference", "opportunity_difference")


@query(f"""{SC}, o AS (SELECT label, row_number() OVER (ORDER BY score, id) - 1 AS i, count(*) OVER () // 4 AS size FROM scored)
SELECT CAST(least(i // size + 1, 4) AS INTEGER) AS slice, count(*) AS n, round(avg(label), 6) AS rate FROM o GROUP BY 1""")
def metric_quartile_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.equal_slices(scored_rows(spark, sf), 4), "rate")


_ACTIONS = f"{SC}, act AS (SELECT score, CAST(id % 2 AS INTEGER) AS treated, label AS outcome, score2, id FROM scored)"


def actions(spark: SparkSession, sf: str) -> DataFrame:
    return scored_rows(spark, sf).select("score", (F.col("id") % 2).cast("int").alias("treated"), F.col("label").alias("outcome"), "score2", "id")


@query(f"""{_ACTIONS}, g AS (SELECT score, count(*) FILTER (treated = 1) AS n1, sum(CASE WHEN treated = 1 THEN outcome ELSE 0 END) AS y1, count(*) FILTER (treated = 0) AS n0, sum(CASE WHEN treated = 0 THEN outcome ELSE 0 END) AS y0 FROM act GROUP BY 1)
SELECT round(score, 6) AS score, CAST(sum(n1) OVER {DOWN} AS BIGINT) AS treated, CAST(sum(n0) OVER {DOWN} AS BIGINT) AS control, round(sum(y1) OVER {DOWN} - sum(y0) OVER {DOWN} * sum(n1) OVER {DOWN} / CAST(sum(n0) OVER {DOWN} AS DOUBLE), 4) AS incremental FROM g""")
def uplift_qini_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(M.uplift_curve(actions(spark, sf)), "score"), "incremental", digits=4)


@query(f"""{_ACTIONS}, l AS (SELECT treated, unnest(['score', 'score2']) AS covariate, unnest([score, score2]) AS x FROM act)
SELECT covariate, round((avg(x) FILTER (treated = 1) - avg(x) FILTER (treated = 0)) / sqrt((var_samp(x) FILTER (treated = 1) + var_samp(x) FILTER (treated = 0)) / 2), 6) AS smd FROM l GROUP BY 1""")
def uplift_balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.balance(actions(spark, sf), ["score", "score2"]), "smd")


@query(f"""{_ACTIONS} SELECT round(avg(outcome) FILTER (treated = 1) - avg(outcome) FILTER (treated = 0), 6) AS uplift, count(*) FILTER (treated = 1) AS treated, count(*) FILTER (treated = 0) AS control FROM act""")
def uplift_estimate(spark: SparkSession, sf: str) -> DataFrame:
    y = lambda t: F.avg(F.when(F.col("treated") == t, F.col("outcome")))
    return actions(spark, sf).agg(F.round(y(1) - y(0), 6).alias("uplift"), F.count(F.when(F.col("treated") == 1, 1)).alias("treated"), F.count(F.when(F.col("treated") == 0, 1)).alias("control"))


@query(f"""{SC}, lg AS (SELECT id % 3 AS taken, CAST(floor(score2 * 51) AS BIGINT) % 3 AS target, CASE WHEN id % 997 = 0 THEN 0.001 ELSE 0.2 + (id % 3) * 0.2 END AS propensity, CAST(label AS DOUBLE) AS reward, 0.3 + 0.1 * score AS q_target, 0.2 + 0.1 * score AS q_taken FROM scored),
v AS (SELECT *, q_target + CASE WHEN taken = target THEN (reward - q_taken) / propensity ELSE 0 END AS v, CASE WHEN taken = target THEN 1 / propensity ELSE 0 END AS w FROM lg)
SELECT round(avg(v), 6) AS value, round(stddev_samp(v) / sqrt(count(*)), 6) AS se, round(power(sum(w), 2) / sum(w * w), 2) AS ess, count(*) FILTER (propensity <= 1e-3) AS violations FROM v""")
def offpolicy_doubly_robust(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 3
    log = scored_rows(spark, sf).select(
        k.alias("taken"), (F.floor(F.col("score2") * 51).cast("bigint") % 3).alias("target"),
        F.when(F.col("id") % 997 == 0, 0.001).otherwise(0.2 + k * 0.2).alias("propensity"), F.col("label").cast("double").alias("reward"), (0.3 + 0.1 * F.col("score")).alias("q_target"), (0.2 + 0.1 * F.col("score")).alias("q_taken"),
    )
    return rounded(rounded(M.doubly_robust(log), "value", "se"), "ess", digits=2)


@query(f"""{SC}, b AS (SELECT CASE WHEN id % 10 = 0 THEN 'missing' ELSE CAST(CAST(floor(score * 5) AS INTEGER) AS VARCHAR) END AS bin, sum(CAST(label = 0 AS INTEGER)) AS goods, sum(CAST(label = 1 AS INTEGER)) AS bads FROM scored GROUP BY 1),
s AS (SELECT *, goods / CAST(sum(goods) OVER () AS DOUBLE) AS gs, bads / CAST(sum(bads) OVER () AS DOUBLE) AS bs FROM b)
SELECT bin, CAST(goods AS BIGINT) AS goods, CAST(bads AS BIGINT) AS bads, round(ln(gs / bs), 6) AS woe, round(ln(gs / bs) * (gs - bs), 8) AS iv FROM s""")
def scorecard_weight_of_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    bin_ = F.when(F.col("id") % 10 != 0, F.floor(F.col("score") * 5).cast("int"))
    return rounded(rounded(M.weight_of_evidence(rows, bin_), "woe"), "iv", digits=8)


@query(f"""{SC}, u AS (SELECT segment, count(*) AS n, sum(label) AS k FROM scored GROUP BY 1)
SELECT segment, n, CAST(k AS BIGINT) AS k, round(greatest(0, (k / CAST(n AS DOUBLE) + 3.8416 / (2 * n) - 1.96 * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
 round(least(1, (k / CAST(n AS DOUBLE) + 3.8416 / (2 * n) + 1.96 * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM u""")
def fairness_wilson(spark: SparkSession, sf: str) -> DataFrame:
    u = scored_rows(spark, sf).groupBy("segment").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("k"))
    low, high = credit.wilson(F.col("k"), F.col("n"))
    return u.select("segment", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""{SC}, d AS (SELECT day, count(*) AS n, avg(CAST((score < 0.5) <> (score2 < 0.5) AS INTEGER)) AS disagreement, avg(CAST(score >= 0.9 AS INTEGER)) AS alerts FROM scored GROUP BY 1) SELECT day, n, round(disagreement, 6) AS disagreement, round(alerts, 6) AS alerts FROM d""")
def shadow_daily(spark: SparkSession, sf: str) -> DataFrame:
    x = scored_rows(spark, sf)
    return x.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("score") < 0.5) != (F.col("score2") < 0.5)).cast("int")), 6).alias("disagreement"), F.round(F.avg((F.col("score") >= 0.9).cast("int")), 6).alias("alerts"))


@query("""WITH m AS (SELECT l_suppkey, avg(CASE WHEN l_linenumber <> 3 THEN l_quantity END) AS mean_by, stddev_samp(CASE WHEN l_linenumber <> 3 THEN l_quantity END) AS sd_by, count(DISTINCT l_partkey) AS kinds FROM lineitem GROUP BY 1),
f AS (SELECT l_quantity, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS frequency FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(coalesce(mean_by, -1), 6) AS mean_by, round(coalesce(sd_by, -1), 6) AS sd_by, kinds, round(frequency, 8) AS frequency FROM lineitem JOIN m USING (l_suppkey) JOIN f USING (l_quantity)""")
def feature_group_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, deviation and distinct count by group, and frequency by value, mapped back onto rows; null becomes -1."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    x = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    m = l.groupBy("l_suppkey").agg(F.round(F.coalesce(F.avg(x), F.lit(-1.0)), 6).alias("mean_by"), F.round(F.coalesce(F.stddev_samp(x), F.lit(-1.0)), 6).alias("sd_by"), F.countDistinct("l_partkey").alias("kinds"))
    f = l.groupBy("l_quantity").agg(F.count("*").alias("n"))
    f = f.select("l_quantity", F.round(F.col("n") / F.sum("n").over(M.whole()), 8).alias("frequency"))
    return l.join(m, "l_suppkey").join(f, "l_quantity").select("l_orderkey", "l_linenumber", "mean_by", "sd_by", "kinds", "frequency")
