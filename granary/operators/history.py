"""One row per applicant from credit records and repayment months, and checks of uploaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days before an application within which a credit record counts as recent.
RECENT_DAYS = 365
#: Months at or above this one are not strictly before the application.
LATEST_MONTH = -1


def bureau(records: DataFrame, key: str = "applicant") -> DataFrame:
    """Credit records by applicant.

    Rows: applicant, status, days (negative, before the application),
    days_overdue, max_overdue, debt, credit, prolonged, overdue. Sums of
    amounts nobody stated are zero; the debt ratio is null without credit.
    """
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
    active = F.col("status") == "Active"
    out = records.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("records"), n(active).alias("active"), n(F.col("status") == "Closed").alias("closed"), n(F.col("days") > -RECENT_DAYS).alias("recent"),
        (-F.min("days")).alias("file_age_days"), (-F.max("days")).alias("days_since_last"), F.max("days_overdue").alias("max_days_overdue"), F.max("max_overdue").alias("max_amount_overdue"),
        total("debt").alias("debt"), total("credit").alias("credit"), total("prolonged").alias("prolonged"), n(active & (F.col("overdue") > 0)).alias("active_overdue"),
    )
    return out.withColumn("debt_ratio", F.col("debt") / F.when(F.col("credit") != 0, F.col("credit")))


def repayments(months: DataFrame, key: str = "applicant") -> DataFrame:
    """Repayment months by applicant; months not strictly before the application, or of unknown time, are left out, and so is who has no other.

    Rows: applicant, month, dpd, dpd_tolerated, status. Months of unknown delay
    count in the mean's divisor, as a month was observed.
    """
    known = months.filter(F.col(key).isNotNull() & (F.col("month") <= LATEST_MONTH))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return known.groupBy(key).agg(
        F.count("*").alias("months_observed"), F.greatest(zero(F.max(F.col("dpd").cast("double"))), F.lit(0.0)).alias("max_dpd"), (zero(F.sum(F.col("dpd").cast("double"))) / F.count("*")).alias("mean_dpd"),
        F.count(F.when(F.col("dpd") > 0, 1)).alias("months_in_arrears"), F.greatest(zero(F.max(F.col("dpd_tolerated").cast("double"))), F.lit(0.0)).alias("max_dpd_tolerated"), F.count(F.when(F.col("status") == "Completed", 1)).alias("completed"),
    )


def attached(rows: DataFrame, history: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with the history's columns and a flag that tells absence from a history of nulls."""
    return rows.join(history.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def checked(stated: Column, computed: Column) -> Column:
    """pass, fail, or not_checkable where nothing was stated."""
    return F.when(stated.isNull(), "not_checkable").when(stated == computed, "pass").otherwise("fail")


def slip_checks(slips: DataFrame, lines: DataFrame, key: str = "slip") -> DataFrame:
    """Whether a slip's lines sum to its stated gross, and gross less deductions to its net, in integer minor units.

    Slips: slip, stated_gross, stated_net. Lines: slip, kind ('earning' or
    'deduction'), amount. A slip without lines sums to zero.
    """
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("amount")).otherwise(0)).cast("bigint").alias(k)
    sums = lines.groupBy(key).agg(part("earning"), part("deduction"))
    out = slips.join(sums, key, "left").withColumn("gross", F.coalesce("earning", F.lit(0))).withColumn("net", F.col("gross") - F.coalesce("deduction", F.lit(0)))
    return out.select(*slips.columns, "gross", "net", checked(F.col("stated_gross"), F.col("gross")).alias("gross_check"), checked(F.col("stated_net"), F.col("net")).alias("net_check"))


def preferred(fetched: Column, uploaded: Column) -> Column:
    """struct(used, source, disagreed): a value fetched under consent wins over an uploaded one, whatever they say."""
    source = F.when(fetched.isNotNull(), "account_aggregator").when(uploaded.isNotNull(), "uploaded_document").otherwise("none")
    return F.struct(F.coalesce(fetched, uploaded).alias("used"), source.alias("source"), F.coalesce(fetched != uploaded, F.lit(False)).alias("disagreed"))


def document_features(reports: DataFrame, key: str = "application") -> DataFrame:
    """Counts of failed and uncheckable checks, and consent features; the latter are null where the posture is unknown.

    Rows: application, posture, uploaded, check, disagreed (one row per check or
    reconciliation, the other column null).
    """
    g = reports.groupBy(key).agg(
        F.max("posture").alias("posture"), F.max("uploaded").alias("uploaded"), F.count(F.when(F.col("check") == "fail", 1)).alias("failures"), F.count(F.when(F.col("check") == "not_checkable", 1)).alias("not_checkable"),
        F.sum(F.col("disagreed").cast("bigint")).alias("disagreements"),
    )
    known = F.col("posture").isin("granted", "refused")
    return g.select(
        key, "failures", "not_checkable", F.when(known, (F.col("posture") == "granted").cast("int")).alias("consent_granted"),
        F.when(known, ((F.col("posture") == "refused") & (F.col("uploaded") > 0)).cast("int")).alias("refused_with_documents"), F.when(known, F.col("disagreements")).alias("disagreements"),
    )
