"""Panel, survival and loss queries over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import credit
from granary.operators import panel as P
from granary.operators import survival as S
from granary.plans.registry import query
from granary.sources.tables import ACCOUNT_MONTHS_SQL as AM
from granary.sources.tables import BUCKET_SQL, account_months, table

B0, B1 = BUCKET_SQL.format(d="dpd"), BUCKET_SQL.format(d="next_dpd")
PAIRS = f"""{AM}, nx AS (SELECT *, lead(month_index) OVER w AS next_month, lead(dpd) OVER w AS next_dpd FROM am WINDOW w AS (PARTITION BY account_id ORDER BY month_index)),
pairs AS (SELECT account_id, month_index, {B0} AS source, {B1} AS target FROM nx WHERE next_month = month_index + 1),
matrix AS (SELECT source, target, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE) AS probability FROM pairs GROUP BY source, target)"""


@query(f"{AM} SELECT * FROM am")
def panel_account_months(spark: SparkSession, sf: str) -> DataFrame:
    return account_months(spark, sf)


@query(f"{PAIRS} SELECT source, target, n, round(probability, 6) AS probability FROM matrix")
def panel_roll_rates(spark: SparkSession, sf: str) -> DataFrame:
    return P.transition_matrix(P.transition_pairs(account_months(spark, sf))).withColumn("probability", F.round("probability", 6))


_STEP = "SELECT coalesce(m.target, s.bucket) AS bucket, sum(s.mass * coalesce(m.probability, 1.0)) AS mass FROM {s} s LEFT JOIN matrix m ON s.bucket = m.source GROUP BY 1"


@query(f"""{PAIRS}, s0 AS (SELECT {B0} AS bucket, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS mass FROM am GROUP BY 1),
s1 AS ({_STEP.format(s='s0')}), s2 AS ({_STEP.format(s='s1')}), s3 AS ({_STEP.format(s='s2')}) SELECT bucket, round(mass, 6) AS mass FROM s3""")
def panel_forecast_three_months(spark: SparkSession, sf: str) -> DataFrame:
    months = account_months(spark, sf)
    start = months.groupBy(credit.bucket_of(F.col("dpd")).alias("bucket")).agg(F.count("*").cast("double").alias("mass"))
    return P.forward(P.transition_matrix(P.transition_pairs(months)), start, 3).withColumn("mass", F.round("mass", 6))


@query(f"""{PAIRS}, half AS (SELECT source, target, count(*) FILTER (month_index >= 23976) AS n, count(*) FILTER (month_index < 23976) AS b FROM pairs GROUP BY ALL),
base AS (SELECT source, target, b / CAST(sum(b) OVER (PARTITION BY source) AS DOUBLE) AS p FROM half WHERE b > 0),
tot AS (SELECT source, sum(n) AS al FROM half GROUP BY 1 HAVING sum(n) > 0)
SELECT source, round(sum(power(coalesce(h.n, 0) - p * al, 2) / (p * al)), 4) AS statistic, count(*) - 1 AS df
FROM base JOIN tot USING (source) LEFT JOIN half h USING (source, target) GROUP BY source""")
def panel_transition_chi_square(spark: SparkSession, sf: str) -> DataFrame:
    pairs = P.transition_pairs(account_months(spark, sf))
    observed, base = P.transition_matrix(pairs.filter("month_index >= 23976")), P.transition_matrix(pairs.filter("month_index < 23976"))
    return P.chi_square(observed, base).withColumn("statistic", F.round("statistic", 4))


@query(f"""{AM}, acc AS (SELECT account_id, max(months_on_book) AS last, min(months_on_book) FILTER (dpd >= 90) AS bad, CAST(year(min(snapshot)) AS VARCHAR) AS cohort FROM am GROUP BY 1),
mob AS (SELECT unnest(range(0, 13)) AS mob)
SELECT cohort, mob, count(*) AS cohort_size, count(*) FILTER (last >= mob) AS at_risk, count(*) FILTER (bad <= mob) AS bad FROM acc, mob GROUP BY ALL""")
def panel_vintage_curves(spark: SparkSession, sf: str) -> DataFrame:
    out = P.vintage_curves(account_months(spark, sf), F.year("opened").cast("string"), 12)
    return out.select("cohort", F.col("mob").cast("bigint").alias("mob"), "cohort_size", "at_risk", "bad")


_WINDOWS = ", ".join(
    f"max(dpd) OVER w{w} AS max_dpd_{w}m, CASE WHEN count(dpd) OVER w{w} > 0 THEN count(CASE WHEN dpd >= 30 THEN 1 END) OVER w{w} END AS times_in_arrears_{w}m" for w in (3, 6, 12)
)


@query(f"""{AM}, f AS (SELECT *, count(dpd) OVER p AS months_observed, count(*) OVER p - count(dpd) OVER p AS months_unobserved, {_WINDOWS}, max(dpd) OVER p AS worst_dpd_ever,
  CASE WHEN count(dpd) OVER q >= 2 THEN last_value(dpd IGNORE NULLS) OVER q - first_value(dpd IGNORE NULLS) OVER q END AS dpd_trend_3m,
  list(balance) FILTER (balance <> 0) OVER p AS bs
  FROM am WINDOW p AS (PARTITION BY account_id ORDER BY month_index ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY account_id ORDER BY month_index ROWS 3 PRECEDING),
  w3 AS (PARTITION BY account_id ORDER BY month_index ROWS 2 PRECEDING), w6 AS (PARTITION BY account_id ORDER BY month_index ROWS 5 PRECEDING), w12 AS (PARTITION BY account_id ORDER BY month_index ROWS 11 PRECEDING))
SELECT account_id, month_index, dpd, months_on_book, months_observed, months_unobserved, max_dpd_3m, times_in_arrears_3m, max_dpd_6m, times_in_arrears_6m, max_dpd_12m, times_in_arrears_12m,
  worst_dpd_ever, CAST(worst_dpd_ever >= 30 AS INTEGER) AS ever_in_arrears, dpd_trend_3m,
  CASE WHEN len(bs) >= 2 AND bs[1] > 0 THEN round(bs[-1] / CAST(bs[1] AS DOUBLE), 6) END AS balance_ratio_to_open,
  CASE WHEN len(bs) >= 4 AND bs[1] > 0 AND bs[-4] > 0 THEN round(bs[-1] / CAST(bs[-4] AS DOUBLE), 6) END AS balance_change_3m FROM f""")
def panel_trailing_features(spark: SparkSession, sf: str) -> DataFrame:
    out = P.trailing_features(account_months(spark, sf)).drop("snapshot", "balance")
    return out.withColumn("balance_ratio_to_open", F.round("balance_ratio_to_open", 6)).withColumn("balance_change_3m", F.round("balance_change_3m", 6))


@query(f"""{AM}, b AS (SELECT *, max(dpd) OVER (PARTITION BY account_id ORDER BY month_index RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS max_ahead, max(month_index) OVER () AS xe FROM am),
s AS (SELECT *, CASE WHEN coalesce(max_ahead >= 90, false) THEN 'observed' WHEN month_index + 12 > xe THEN 'censored' WHEN max_ahead IS NULL THEN 'unobserved' ELSE 'observed' END AS status FROM b)
SELECT account_id, snapshot, month_index, months_on_book, dpd, balance, max_ahead, status,
  CASE WHEN status = 'observed' THEN CASE WHEN max_ahead >= 90 THEN 'BAD' WHEN max_ahead >= 30 THEN 'INDETERMINATE' ELSE 'GOOD' END END AS label FROM s""")
def panel_behavioural_labels(spark: SparkSession, sf: str) -> DataFrame:
    return P.behavioural_labels(account_months(spark, sf))


HAZ = f"""{AM}, hz AS (SELECT *, min(month_index) FILTER (dpd >= 90) OVER (PARTITION BY account_id) AS em FROM am),
haz AS (SELECT *, CAST(coalesce(month_index = em, false) AS INTEGER) AS event FROM hz WHERE em IS NULL OR month_index <= em)"""


@query(f"{HAZ} SELECT months_on_book, count(*) AS at_risk, CAST(sum(event) AS BIGINT) AS events, round(sum(event) / CAST(count(*) AS DOUBLE), 6) AS hazard FROM haz GROUP BY 1")
def panel_observed_hazard(spark: SparkSession, sf: str) -> DataFrame:
    return P.observed_hazard(P.hazard_rows(account_months(spark, sf))).withColumn("hazard", F.round("hazard", 6))


SUBJECTS = f"""{AM}, sj AS (SELECT account_id, min(months_on_book) FILTER (dpd >= 90) AS bad, max(months_on_book) AS last, max(month_index) AS seen, arg_max(balance, month_index) AS balance,
  (SELECT max(month_index) FROM am) AS xe FROM am GROUP BY 1),
subj AS (SELECT account_id, coalesce(bad, last) AS time, CASE WHEN bad IS NOT NULL THEN 1 WHEN seen < xe - 6 THEN 2 ELSE 0 END AS cause, balance FROM sj)"""
_KM = """, t AS (SELECT time, count(*) AS n, count(*) FILTER (cause = {k}) AS d FROM subj GROUP BY 1),
r AS (SELECT time, d, sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk FROM t)
SELECT time, CAST(at_risk AS BIGINT) AS at_risk, d, round(product(1 - d / CAST(at_risk AS DOUBLE)) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 6) AS survival FROM r WHERE d > 0"""


@query(SUBJECTS + _KM.format(k=1))
def survival_kaplan_meier(spark: SparkSession, sf: str) -> DataFrame:
    return S.kaplan_meier(P.survival_subjects(account_months(spark, sf))).withColumn("survival", F.round("survival", 6))


@query(SUBJECTS + _KM.format(k=0))
def survival_censoring(spark: SparkSession, sf: str) -> DataFrame:
    return S.censoring_survival(P.survival_subjects(account_months(spark, sf))).withColumn("survival", F.round("survival", 6))


@query(SUBJECTS + """, t AS (SELECT time, count(*) AS n, count(*) FILTER (cause = 1) AS d1, count(*) FILTER (cause = 2) AS d2 FROM subj GROUP BY 1),
r AS (SELECT time, d1, d2, CAST(sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_risk FROM t),
h AS (SELECT *, d1 / CAST(at_risk AS DOUBLE) AS h1, d2 / CAST(at_risk AS DOUBLE) AS h2 FROM r),
a AS (SELECT *, coalesce(product(1 - h1 - h2) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS alive, 1 - product(1 - h1) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS naive FROM h)
SELECT time, at_risk, d1, d2, round(sum(alive * h1) OVER w, 6) AS cif1, round(sum(alive * h2) OVER w, 6) AS cif2, round(naive, 6) AS naive FROM a WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING)""")
def survival_cumulative_incidence(spark: SparkSession, sf: str) -> DataFrame:
    out = S.cumulative_incidence(P.survival_subjects(account_months(spark, sf)))
    return out.select("time", "at_risk", "d1", "d2", *[F.round(c, 6).alias(c) for c in ("cif1", "cif2", "naive")])


@query(SUBJECTS + """, k AS (SELECT time, cause = 1 AS event, balance // 10000000 AS risk, count(*) AS n FROM subj GROUP BY ALL)
SELECT CAST(sum(a.n * b.n) AS BIGINT) AS comparable, CAST(sum(CASE WHEN a.risk > b.risk THEN a.n * b.n ELSE 0 END) AS BIGINT) AS concordant, CAST(sum(CASE WHEN a.risk = b.risk THEN a.n * b.n ELSE 0 END) AS BIGINT) AS tied,
  round((sum(CASE WHEN a.risk > b.risk THEN a.n * b.n ELSE 0 END) + 0.5 * sum(CASE WHEN a.risk = b.risk THEN a.n * b.n ELSE 0 END)) / CAST(sum(a.n * b.n) AS DOUBLE), 6) AS c
FROM k a JOIN k b ON a.event AND (b.time > a.time OR (b.time = a.time AND NOT b.event))""")
def survival_concordance(spark: SparkSession, sf: str) -> DataFrame:
    subjects = P.survival_subjects(account_months(spark, sf))
    return S.concordance(subjects, F.floor(F.col("balance") / 10000000)).withColumn("c", F.round("c", 6))


@query(SUBJECTS + """, t AS (SELECT time, count(*) AS n, count(*) FILTER (cause = 0) AS d FROM subj GROUP BY 1),
r AS (SELECT time, d, sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk FROM t),
g AS (SELECT time AS tt, product(1 - d / CAST(at_risk AS DOUBLE)) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM r WHERE d > 0),
x AS (SELECT time, cause, coalesce((SELECT arg_max(s, tt) FROM g WHERE tt < subj.time), 1.0) AS gb, coalesce((SELECT arg_max(s, tt) FROM g WHERE tt <= 12), 1.0) AS gt FROM subj)
SELECT round(avg(CASE WHEN time <= 12 AND cause = 1 THEN 0.64 / gb WHEN time > 12 THEN 0.04 / gt ELSE 0 END), 6) AS brier FROM x""")
def survival_brier(spark: SparkSession, sf: str) -> DataFrame:
    return S.brier_at(P.survival_subjects(account_months(spark, sf)), 0.8, 12).withColumn("brier", F.round("brier", 6))


_EXPOSURE = """WITH ex AS (SELECT l_orderkey, l_linenumber, l_returnflag AS segment, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_discount END AS pd,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_tax * 5 END AS lgd, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS ead FROM lineitem)"""


def exposures(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("segment"), F.when(line % 7 != 0, F.col("l_discount")).alias("pd"), F.when(line % 5 != 0, F.col("l_tax") * 5).alias("lgd"), credit.minor_units(F.col("l_extendedprice")).alias("ead")
    )


@query(f"""{_EXPOSURE} SELECT segment, count(*) AS n, CAST(sum(ead) AS BIGINT) AS ead, CAST(sum(CAST(round_even(pd * lgd * ead, 0) AS BIGINT)) AS BIGINT) AS expected_loss,
  count(*) - count(pd) AS missing_pd, count(*) - count(lgd) AS missing_lgd, round((count(*) - greatest(count(*) - count(pd), count(*) - count(lgd))) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM ex GROUP BY 1""")
def loss_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    x = exposures(spark, sf)
    el = credit.expected_loss(F.col("pd"), F.col("lgd"), F.col("ead"))
    out = x.groupBy("segment").agg(F.count("*").alias("n"), F.sum("ead").alias("ead"), F.sum(el).alias("expected_loss"), F.count(F.when(F.col("pd").isNull(), 1)).alias("missing_pd"), F.count(F.when(F.col("lgd").isNull(), 1)).alias("missing_lgd"))
    return out.withColumn("coverage", F.round((F.col("n") - F.greatest("missing_pd", "missing_lgd")) / F.col("n"), 6))


@query(f"""{AM}, st AS (SELECT account_id, month_index, dpd, balance % 11 = 0 AS red, CASE WHEN balance % 13 = 0 THEN NULL ELSE (balance % 97) / 97.0 END AS lifetime, (balance % 5) / 10.0 AS orig FROM am),
x AS (SELECT *, lifetime / CASE WHEN orig > 0 THEN orig END AS ratio FROM st),
y AS (SELECT *, CASE WHEN coalesce(dpd, 0) >= 90 THEN 3 WHEN coalesce(dpd >= 30, false) OR red OR coalesce(ratio > 2.0, false) THEN 2 WHEN ratio IS NOT NULL THEN 1 END AS stage FROM x)
SELECT account_id, month_index, stage, CASE WHEN stage = 3 THEN 'credit_impaired' ELSE concat_ws(',', CASE WHEN dpd >= 30 THEN 'dpd_backstop' END, CASE WHEN red THEN 'ews_red_flag' END, CASE WHEN ratio > 2.0 THEN 'sicr_pd_ratio' END) END AS triggers FROM y""")
def panel_staging(spark: SparkSession, sf: str) -> DataFrame:
    m = account_months(spark, sf)
    lifetime = F.when(F.col("balance") % 13 != 0, (F.col("balance") % 97) / 97.0)
    s = credit.stage(F.col("dpd"), F.lit(False), F.col("balance") % 11 == 0, lifetime, (F.col("balance") % 5) / 10.0, 2.0)
    return m.select("account_id", "month_index", s.alias("s")).select("account_id", "month_index", "s.stage", F.array_join("s.triggers", ",").alias("triggers"))


@query(f"""{AM} SELECT count(*) AS months, count(DISTINCT account_id) AS accounts, min(snapshot) AS first_snapshot, max(snapshot) AS last_snapshot, count(*) - count(dpd) AS unknown FROM am""")
def panel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return account_months(spark, sf).agg(F.count("*").alias("months"), F.countDistinct("account_id").alias("accounts"), F.min("snapshot").alias("first_snapshot"), F.max("snapshot").alias("last_snapshot"), F.count(F.when(F.col("dpd").isNull(), 1)).alias("unknown"))


@query(f"""{AM}, o AS (SELECT account_id, max(dpd) AS max_dpd, max(balance) > 60000000 AS written_off, min(snapshot) AS opened FROM am GROUP BY 1)
SELECT CASE WHEN max_dpd IS NULL THEN 'undetermined' WHEN account_id % 17 = 0 THEN 'staff' WHEN year(opened) >= 1997 THEN 'too_recent' ELSE 'kept' END AS outcome,
  CASE WHEN coalesce(max_dpd >= 90, false) OR coalesce(written_off, false) THEN 'BAD' WHEN coalesce(max_dpd BETWEEN 30 AND 89, false) THEN 'INDETERMINATE' ELSE 'GOOD' END AS label, count(*) AS n FROM o GROUP BY ALL""")
def target_table_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every account under the first exclusion that it meets, by label: the counts add up to the accounts read."""
    o = account_months(spark, sf).groupBy("account_id").agg(F.max("dpd").alias("max_dpd"), (F.max("balance") > 60000000).alias("written_off"), F.min("snapshot").alias("opened"))
    outcome = F.when(F.col("max_dpd").isNull(), "undetermined").when(F.col("account_id") % 17 == 0, "staff").when(F.year("opened") >= 1997, "too_recent").otherwise("kept")
    return o.groupBy(outcome.alias("outcome"), credit.label(F.col("max_dpd"), F.col("written_off")).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS vintage, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT vintage, n, (sum(n) OVER (ORDER BY vintage ROWS UNBOUNDED PRECEDING) - n / 2.0) / sum(n) OVER () AS mid FROM v)
SELECT vintage, n, CASE WHEN mid < 0.70 THEN 'train' WHEN mid < 0.85 THEN 'validation' ELSE 'test' END AS part FROM m""")
def split_by_vintage(spark: SparkSession, sf: str) -> DataFrame:
    """Whole vintages, by the midpoint of their share of all rows in order."""
    v = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("string").alias("vintage")).agg(F.count("*").alias("n"))
    past = Window.partitionBy(F.lit(0)).orderBy("vintage").rowsBetween(Window.unboundedPreceding, 0)
    mid = (F.sum("n").over(past) - F.col("n") / 2.0) / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return v.select("vintage", "n", F.when(mid < 0.70, "train").when(mid < 0.85, "validation").otherwise("test").alias("part"))


@query("""SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_discount = 0 THEN l_extendedprice / 24 ELSE l_extendedprice * (l_discount / 12) * power(1 + l_discount / 12, 24) / (power(1 + l_discount / 12, 24) - 1) END + 1e-9, 4) AS emi,
  CAST(round_even(CASE WHEN l_discount = 0 THEN l_extendedprice * (1 - 7.0 / 24) ELSE l_extendedprice * (power(1 + l_discount / 12, 24) - power(1 + l_discount / 12, 7)) / (power(1 + l_discount / 12, 24) - 1) END, 0) AS BIGINT) AS balance,
  round(CASE WHEN l_extendedprice - l_quantity * 500 >= 1 THEN least(greatest((l_extendedprice * 0.9 - l_quantity * 500) / (l_extendedprice - l_quantity * 500), 0), 1) END, 6) AS ccf,
  round(least(greatest((l_extendedprice + 100 - l_quantity * 800) / l_extendedprice, 0), 1), 6) AS lgd FROM lineitem""")
def finance_terms(spark: SparkSession, sf: str) -> DataFrame:
    p, q, r = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(credit.emi(p, r, F.lit(24)) + 1e-9, 4).alias("emi"), credit.scheduled_balance(p, r, F.lit(24), F.lit(7)).alias("balance"),
        F.round(credit.realised_ccf(p * 0.9, q * 500, p), 6).alias("ccf"), F.round(credit.realised_lgd(p, F.lit(100), q * 800), 6).alias("lgd"),
    )


@query("""SELECT c_custkey, CASE WHEN c_acctbal <= 1000 THEN 'APPROVE' WHEN c_acctbal >= 8000 THEN 'DECLINE' ELSE 'REFER' END AS outcome,
  CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 500 AS canary,
  CASE WHEN c_acctbal > 0 THEN CASE WHEN 500 / c_acctbal < 0.15 THEN 'comfortable' WHEN 500 / c_acctbal < 0.30 THEN 'moderate' ELSE 'stretched' END ELSE 'unknown' END AS affordability FROM customer""")
def decision_bands(spark: SparkSession, sf: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", credit.band_outcome(bal, 1000, 8000).alias("outcome"), credit.canary(F.col("c_custkey").cast("string").cast("binary"), 5).alias("canary"), credit.affordability(F.lit(500), bal).alias("affordability"))
