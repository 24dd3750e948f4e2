"""Account-month panels: transitions, vintages, labels, trailing features, hazards.

A panel has account_id, snapshot, month_index, months_on_book, dpd and balance.
All windows are partitioned by account, so no window grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import credit

def account():
    """An account's months in order."""
    return Window.partitionBy("account_id").orderBy("month_index")


def transition_pairs(panel: DataFrame) -> DataFrame:
    """Consecutive months of an account, exactly one apart: source and target bucket."""
    nxt = panel.withColumn("next_month", F.lead("month_index").over(account())).withColumn("next_dpd", F.lead("dpd").over(account()))
    return nxt.filter(F.col("next_month") == F.col("month_index") + 1).select("account_id", "month_index", credit.bucket_of(F.col("dpd")).alias("source"), credit.bucket_of(F.col("next_dpd")).alias("target"))


def transition_matrix(pairs: DataFrame) -> DataFrame:
    """source, target, n and the share of the source's row."""
    counts = pairs.groupBy("source", "target").agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def forward(matrix: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """Distribution (bucket, mass) after ``steps`` months; a bucket without a row keeps its mass. Tables of seven rows."""
    now = start.crossJoin(start.agg(F.sum("mass").alias("all"))).select("bucket", (F.col("mass") / F.col("all")).alias("mass"))
    for _ in range(steps):
        moved = now.join(matrix, now["bucket"] == matrix["source"], "left")
        now = moved.select(F.coalesce("target", "bucket").alias("b"), (F.col("mass") * F.coalesce("probability", F.lit(1.0))).alias("m")).groupBy(F.col("b").alias("bucket")).agg(F.sum("m").alias("mass"))
    return now


def chi_square(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per source bucket: sum of (observed - expected)^2 / expected over the baseline's cells, and cells less one."""
    totals = observed.groupBy("source").agg(F.sum("n").alias("all"))
    expected = baseline.join(totals, "source").select("source", "target", (F.col("probability") * F.col("all")).alias("expected"))
    joined = expected.join(observed.select("source", "target", "n"), ["source", "target"], "left")
    term = F.pow(F.coalesce("n", F.lit(0)) - F.col("expected"), F.lit(2)) / F.col("expected")
    return joined.groupBy("source").agg(F.sum(term).alias("statistic"), (F.count("*") - 1).alias("df"))


def vintage_curves(panel: DataFrame, cohort: Column, months: int) -> DataFrame:
    """cohort, mob, cohort size, accounts still observed, and accounts that have defaulted by then."""
    bad = F.min(F.when(F.col("dpd") >= credit.DEFAULT_DPD, F.col("months_on_book")))
    first = F.min_by("snapshot", "month_index")
    accounts = panel.groupBy("account_id").agg(F.max("months_on_book").alias("last"), bad.alias("bad"), first.alias("opened")).select(cohort.alias("cohort"), "last", "bad")
    # Counted by cohort and month first, then summed over a small table.
    ends = accounts.groupBy("cohort", F.least("last", F.lit(months)).alias("last"), F.when(F.col("bad") <= months, F.col("bad")).alias("bad")).agg(F.count("*").alias("n"))
    grid = ends.withColumn("mob", F.explode(F.sequence(F.lit(0), F.lit(months))))
    return grid.groupBy("cohort", "mob").agg(F.sum("n").alias("cohort_size"), F.sum(F.when(F.col("last") >= F.col("mob"), F.col("n")).otherwise(0)).alias("at_risk"), F.sum(F.when(F.col("bad") <= F.col("mob"), F.col("n")).otherwise(0)).alias("bad"))


def trailing_features(panel: DataFrame) -> DataFrame:
    """Features from the months up to each row; windows count rows, and unknown months give null rather than 0."""
    past = account().rowsBetween(Window.unboundedPreceding, 0)
    out = panel.withColumn("months_observed", F.count("dpd").over(past)).withColumn("months_unobserved", F.count("*").over(past) - F.col("months_observed"))
    for w in (3, 6, 12):
        recent = account().rowsBetween(-(w - 1), 0)
        out = out.withColumn(f"max_dpd_{w}m", F.max("dpd").over(recent))
        out = out.withColumn(f"times_in_arrears_{w}m", F.when(F.count("dpd").over(recent) > 0, F.count(F.when(F.col("dpd") >= 30, 1)).over(recent)))
    out = out.withColumn("worst_dpd_ever", F.max("dpd").over(past)).withColumn("ever_in_arrears", (F.col("worst_dpd_ever") >= 30).cast("int"))
    quarter = account().rowsBetween(-3, 0)
    out = out.withColumn("dpd_trend_3m", F.when(F.count("dpd").over(quarter) >= 2, F.last("dpd", True).over(quarter) - F.first("dpd", True).over(quarter)))
    some = F.when(F.col("balance") != 0, F.col("balance"))
    out = out.withColumn("b_n", F.count(some).over(past)).withColumn("b_first", F.first(some, True).over(past)).withColumn("b_last", F.last(some, True).over(past))
    # The fourth last balance that is not zero: three such rows back from one, and carried over rows with none.
    counted = Window.partitionBy("account_id", some.isNotNull()).orderBy("month_index")
    out = out.withColumn("b_three_back", F.when(some.isNotNull(), F.lag("balance", 3).over(counted)))
    fourth = F.when(F.col("b_n") >= 4, F.last("b_three_back", True).over(past))
    judged = (F.col("b_n") >= 2) & (F.col("b_first") > 0)
    out = out.withColumn("balance_ratio_to_open", F.when(judged, F.col("b_last") / F.col("b_first")))
    out = out.withColumn("balance_change_3m", F.when(judged & (fourth > 0), F.col("b_last") / fourth))
    return out.drop("b_n", "b_first", "b_last", "b_three_back")


def behavioural_labels(panel: DataFrame, horizon: int = 12) -> DataFrame:
    """Label over the months (t, t + horizon]: BAD on a default, censored past the extract's end, null if nothing is known."""
    ahead = account().rangeBetween(1, horizon)
    end = panel.agg(F.max("month_index").alias("extract_end"))
    out = panel.withColumn("max_ahead", F.max("dpd").over(ahead)).crossJoin(F.broadcast(end))
    default = credit.true(F.col("max_ahead") >= credit.DEFAULT_DPD)
    status = F.when(default, "observed").when(F.col("month_index") + horizon > F.col("extract_end"), "censored").when(F.col("max_ahead").isNull(), "unobserved").otherwise("observed")
    out = out.withColumn("status", status)
    return out.withColumn("label", F.when(F.col("status") == "observed", credit.label(F.col("max_ahead")))).drop("extract_end")


def hazard_rows(panel: DataFrame) -> DataFrame:
    """Person-periods up to each account's first default, the event on its month."""
    first = F.min(F.when(F.col("dpd") >= credit.DEFAULT_DPD, F.col("month_index"))).over(Window.partitionBy("account_id"))
    out = panel.withColumn("event_month", first).filter(F.col("event_month").isNull() | (F.col("month_index") <= F.col("event_month")))
    return out.withColumn("event", credit.true(F.col("month_index") == F.col("event_month")).cast("int"))


def observed_hazard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("months_on_book").agg(F.count("*").alias("at_risk"), F.sum("event").alias("events")).withColumn("hazard", F.col("events") / F.col("at_risk"))


def survival_subjects(panel: DataFrame) -> DataFrame:
    """One row per account: time in months and cause (1 default, 2 closed after its last month, 0 censored at the extract's end)."""
    end = panel.agg(F.max("month_index").alias("extract_end"))
    bad = F.min(F.when(F.col("dpd") >= credit.DEFAULT_DPD, F.col("months_on_book")))
    one = panel.groupBy("account_id").agg(bad.alias("bad"), F.max("months_on_book").alias("last"), F.max("month_index").alias("seen"), F.max_by("balance", "month_index").alias("balance")).crossJoin(F.broadcast(end))
    cause = F.when(F.col("bad").isNotNull(), 1).when(F.col("seen") < F.col("extract_end") - 6, 2).otherwise(0)
    return one.select("account_id", F.coalesce("bad", "last").alias("time"), cause.alias("cause"), "balance")
