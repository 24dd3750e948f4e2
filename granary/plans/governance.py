"""Queries over applicant histories, document checks, suitability, schemas, promotions and golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import credit
from granary.operators import governance as V
from granary.operators import history as H
from granary.plans.registry import query
from granary.plans.scoring import rounded
from granary.sources.tables import table

_BUREAU = """WITH b AS (SELECT o_custkey AS applicant, CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Sold' END AS status, date_diff('day', DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS days,
  CAST(o_orderkey % 40 AS INTEGER) AS days_overdue, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 10 END AS max_overdue, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 2 END AS debt, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS credit,
  o_orderkey % 2 AS prolonged, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice / 20 END AS overdue FROM orders)"""


@query(f"""{_BUREAU}, g AS (SELECT applicant, count(*) AS records, count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status = 'Closed') AS closed, count(*) FILTER (days > -365) AS recent, -min(days) AS file_age_days, -max(days) AS days_since_last,
max(days_overdue) AS max_days_overdue, round(max(max_overdue), 4) AS max_amount_overdue, coalesce(sum(debt), 0) AS debt, coalesce(sum(credit), 0) AS credit, CAST(sum(prolonged) AS DOUBLE) AS prolonged, count(*) FILTER (status = 'Active' AND overdue > 0) AS active_overdue FROM b GROUP BY 1),
h AS (SELECT g.* REPLACE (round(debt, 4) AS debt, round(credit, 4) AS credit), round(debt / CASE WHEN credit <> 0 THEN credit END, 6) AS debt_ratio FROM g)
SELECT c_custkey AS applicant, h.* EXCLUDE (applicant), h.applicant IS NOT NULL AS has_history FROM customer LEFT JOIN h ON applicant = c_custkey""")
def history_bureau(spark: SparkSession, sf: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    b = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("applicant"), F.when(F.col("o_orderstatus") == "F", "Closed").when(F.col("o_orderstatus") == "O", "Active").otherwise("Sold").alias("status"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date")).alias("days"),
        (k % 40).cast("int").alias("days_overdue"), F.when(k % 3 == 0, price / 10).alias("max_overdue"), F.when(k % 4 > 0, price / 2).alias("debt"), F.when(k % 5 > 0, price).alias("credit"), (k % 2).alias("prolonged"), F.when(k % 6 == 0, price / 20).alias("overdue"),
    )
    h = rounded(rounded(H.bureau(b), "debt_ratio"), "max_amount_overdue", "debt", "credit", digits=4)
    return H.attached(table(spark, sf, "customer").select(F.col("c_custkey").alias("applicant")), h, "applicant", "has_history")


@query("""WITH m AS (SELECT l_suppkey AS applicant, CAST(l_partkey % 14 AS INTEGER) - 12 AS month, CASE WHEN l_linenumber < 7 THEN greatest(l_quantity - 30, 0) END AS dpd, CASE WHEN l_linenumber < 5 THEN greatest(l_quantity - 45, 0) END AS dpd_tolerated, CASE WHEN l_returnflag = 'R' THEN 'Completed' ELSE 'Active' END AS status FROM lineitem)
SELECT applicant, count(*) AS months_observed, coalesce(max(dpd), 0) AS max_dpd, round(coalesce(sum(dpd), 0) / count(*), 6) AS mean_dpd, count(*) FILTER (dpd > 0) AS months_in_arrears, coalesce(max(dpd_tolerated), 0) AS max_dpd_tolerated, count(*) FILTER (status = 'Completed') AS completed FROM m WHERE month <= -1 GROUP BY 1""")
def history_repayments(spark: SparkSession, sf: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    m = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("applicant"), ((F.col("l_partkey") % 14).cast("int") - 12).alias("month"), F.when(n < 7, F.greatest(q - 30, F.lit(0.0))).alias("dpd"),
        F.when(n < 5, F.greatest(q - 45, F.lit(0.0))).alias("dpd_tolerated"), F.when(F.col("l_returnflag") == "R", "Completed").otherwise("Active").alias("status"),
    )
    return rounded(H.repayments(m), "mean_dpd")


_SLIPS = """WITH ln AS (SELECT l_orderkey AS slip, CASE WHEN l_linenumber % 3 = 0 THEN 'deduction' ELSE 'earning' END AS kind, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS amount FROM lineitem),
sm AS (SELECT slip, CAST(sum(CASE WHEN kind = 'earning' THEN amount ELSE 0 END) AS BIGINT) AS e, CAST(sum(CASE WHEN kind = 'deduction' THEN amount ELSE 0 END) AS BIGINT) AS d FROM ln GROUP BY 1),
sl AS (SELECT o_orderkey AS slip, coalesce(e, 0) AS gross, coalesce(e, 0) - coalesce(d, 0) AS net, CASE WHEN o_orderkey % 5 > 0 THEN coalesce(e, 0) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END END AS stated_gross, CASE WHEN o_orderkey % 6 > 0 THEN coalesce(e, 0) - coalesce(d, 0) - CASE WHEN o_orderkey % 11 = 0 THEN 100 ELSE 0 END END AS stated_net FROM orders LEFT JOIN sm ON slip = o_orderkey),
ck AS (SELECT *, CASE WHEN stated_gross IS NULL THEN 'not_checkable' WHEN stated_gross = gross THEN 'pass' ELSE 'fail' END AS gross_check, CASE WHEN stated_net IS NULL THEN 'not_checkable' WHEN stated_net = net THEN 'pass' ELSE 'fail' END AS net_check FROM sl)"""


def slip_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as salary slips: stated totals are missing on some and off on others."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slip"), F.when(F.col("l_linenumber") % 3 == 0, "deduction").otherwise("earning").alias("kind"), credit.minor_units(F.col("l_extendedprice")).alias("amount"))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).alias(k)
    k, e, d = F.col("slip"), F.coalesce("earning", F.lit(0)), F.coalesce("deduction", F.lit(0))
    slips = table(spark, sf, "orders").select(F.col("o_orderkey").alias("slip")).join(lines.groupBy("slip").agg(part("earning"), part("deduction")), "slip", "left")
    slips = slips.select("slip", F.when(k % 5 > 0, e + F.when(k % 7 == 0, 1).otherwise(0)).alias("stated_gross"), F.when(k % 6 > 0, e - d - F.when(k % 11 == 0, 100).otherwise(0)).alias("stated_net"))
    return H.slip_checks(slips, lines)


@query(f"{_SLIPS} SELECT slip, stated_gross, stated_net, gross, net, gross_check, net_check FROM ck")
def document_slip_checks(spark: SparkSession, sf: str) -> DataFrame:
    return slip_checks(spark, sf)


@query(f"""{_SLIPS} SELECT slip AS application, CAST((gross_check = 'fail') AS BIGINT) + CAST((net_check = 'fail') AS BIGINT) AS failures, CAST((gross_check = 'not_checkable') AS BIGINT) + CAST((net_check = 'not_checkable') AS BIGINT) AS not_checkable,
CASE WHEN slip % 3 = 1 THEN 1 WHEN slip % 3 = 2 THEN 0 END AS consent_granted, CASE WHEN slip % 3 = 1 THEN 0 WHEN slip % 3 = 2 THEN CASE WHEN slip % 4 > 0 THEN 1 ELSE 0 END END AS refused_with_documents,
CASE WHEN slip % 3 > 0 THEN CAST(coalesce(stated_gross <> gross, false) AS BIGINT) END AS disagreements, coalesce(gross, stated_gross) AS used FROM ck""")
def document_consent_features(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("slip")
    c = slip_checks(spark, sf).withColumn("r", H.preferred(F.col("gross"), F.col("stated_gross")))
    posture = F.when(k % 3 == 1, "granted").when(k % 3 == 2, "refused").otherwise("unknown")
    none, row = F.lit(None), lambda check, d: F.struct(check.cast("string").alias("check"), d.cast("boolean").alias("disagreed"))
    rows = c.select(k.alias("application"), posture.alias("posture"), (k % 4).alias("uploaded"), F.explode(F.array(row(F.col("gross_check"), none), row(F.col("net_check"), none), row(none, F.col("r.disagreed")))).alias("x"))
    return H.document_features(rows.select("application", "posture", "uploaded", "x.*")).join(c.select(k.alias("application"), F.col("r.used").alias("used")), "application")


@query("""WITH r AS (SELECT o_orderkey AS offer, o_custkey AS borrower, CASE WHEN o_orderkey % 9 = 0 THEN 'drought_flagged' ELSE 'sowing' END AS stage, o_totalprice / 60 AS emi FROM orders),
a AS (SELECT c_custkey AS borrower, CASE WHEN c_mktsegment = 'BUILDING' THEN 'retail' ELSE 'agri' END AS segment, CASE WHEN c_custkey % 8 > 0 THEN c_acctbal * 10 END AS cash FROM customer), x AS (SELECT * FROM r JOIN a USING (borrower))
SELECT offer, 'drought_marketing' AS "check" FROM x WHERE stage = 'drought_flagged' UNION ALL SELECT offer, 'no_stressed_cash_flow' FROM x WHERE segment <> 'retail' AND cash IS NULL UNION ALL SELECT offer, 'stressed_affordability' FROM x WHERE segment <> 'retail' AND emi * 12 > cash""")
def suitability_findings(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("offer"), F.col("o_custkey").alias("borrower"), F.when(F.col("o_orderkey") % 9 == 0, "drought_flagged").otherwise("sowing").alias("stage"), (F.col("o_totalprice") / 60).alias("emi"))
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("borrower"), F.when(F.col("c_mktsegment") == "BUILDING", "retail").otherwise("agri").alias("segment"), F.when(F.col("c_custkey") % 8 > 0, F.col("c_acctbal") * 10).alias("stressed_cash_flow"))
    return V.suitability(r, a).select("offer", "check")


TYPES = ["int", "long", "float", "double", "string", "bytes", "boolean"]
_WIDER = "(o = n OR (o = 'int' AND n IN ('long', 'float', 'double')) OR (o = 'long' AND n IN ('float', 'double')) OR (o = 'float' AND n = 'double') OR (o = 'string' AND n = 'bytes') OR (o = 'bytes' AND n = 'string'))"


@query(f"""WITH t AS (SELECT {TYPES!r} AS t), f AS (SELECT p_partkey // 20 AS record, p_partkey % 20 AS field, [t[p_size % 7 + 1]] AS ot, p_size % 3 = 0 AS od, p_partkey % 11 > 0 AS was, [t[(p_size + p_partkey % 2) % 7 + 1], 'double'] AS nt, p_size % 4 = 0 AS nd, p_partkey % 13 > 0 AS now FROM part, t),
i AS (SELECT record, field, unnest([CASE WHEN NOT was AND NOT nd THEN 'added_without_default' END, CASE WHEN NOT now THEN 'removed' END,
  CASE WHEN was AND now AND EXISTS (SELECT 1 FROM unnest(ot) AS a(o) WHERE NOT EXISTS (SELECT 1 FROM unnest(nt) AS b(n) WHERE {_WIDER})) THEN 'type_changed' END, CASE WHEN was AND now AND od AND NOT nd THEN 'default_removed' END]) AS issue FROM f WHERE was OR now)
SELECT record, field, issue, CASE WHEN issue = 'removed' THEN 'warning' ELSE 'breaking' END AS severity FROM i WHERE issue IS NOT NULL""")
def schema_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as fields of records in an old and a new version."""
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = lambda i: F.get(F.array(*map(F.lit, TYPES)), i.cast("int"))
    p = table(spark, sf, "part").select(F.floor(k / 20).alias("record"), (k % 20).alias("field"), "p_size", "p_partkey")
    old = p.filter(k % 11 > 0).select("record", "field", F.array(kind(s % 7)).alias("types"), (s % 3 == 0).alias("has_default"))
    new = p.filter(k % 13 > 0).select("record", "field", F.array(kind((s + k % 2) % 7), F.lit("double")).alias("types"), (s % 4 == 0).alias("has_default"))
    return V.compatibility(old, new)


@query("""WITH m AS (SELECT c_custkey AS model, ['none', 'staging', 'production', 'archived'][c_custkey % 4 + 1] AS current, ['production', 'staging', 'archived'][c_custkey % 3 + 1] AS target, c_custkey % 10 > 0 AS ci, CASE WHEN c_custkey % 7 > 0 THEN 'card' ELSE '' END AS card, CASE WHEN c_custkey % 5 > 0 THEN 'report' END AS report,
  CASE WHEN c_custkey % 6 > 0 THEN DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) END AS started, c_custkey % 9 > 0 AS warm, CASE WHEN c_custkey % 8 > 0 THEN 'v1' ELSE 'v0' END AS trained FROM customer)
SELECT model, concat_ws(',', CASE WHEN NOT ((current = 'none' AND target IN ('staging', 'archived')) OR (current = 'staging' AND target IN ('production', 'archived', 'none')) OR (current = 'production' AND target IN ('archived', 'staging')) OR (current = 'archived' AND target = 'staging')) THEN 'illegal_transition' END,
 CASE WHEN NOT ci THEN 'not_by_pipeline' END, CASE WHEN target = 'production' AND card = '' THEN 'no_model_card' END, CASE WHEN target = 'production' AND report IS NULL THEN 'no_validation_report' END, CASE WHEN target = 'production' AND started IS NULL THEN 'no_shadow' END,
 CASE WHEN target = 'production' AND DATE '2024-03-01' - started < 28 THEN 'short_shadow' END, CASE WHEN target = 'production' AND NOT warm THEN 'fallback_cold' END, CASE WHEN target = 'production' AND trained <> 'v1' THEN 'other_definitions' END) AS blocks FROM m""")
def model_promotion_blocks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    started = F.when(k % 6 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")))
    blocks = V.promotion_blocks(
        pick(["none", "staging", "production", "archived"], k % 4), pick(["production", "staging", "archived"], k % 3), k % 10 > 0, F.when(k % 7 > 0, "card").otherwise(""), F.when(k % 5 > 0, "report"),
        started, k % 9 > 0, F.when(k % 8 > 0, "v1").otherwise("v0"), F.lit("v1"), F.lit("2024-03-01").cast("date"),
    )
    return table(spark, sf, "customer").select(k.alias("model"), F.array_join(blocks, ",").alias("blocks"))


@query("""WITH g AS (SELECT c_custkey AS model, c_mktsegment AS population, DATE '2024-01-01' AS s, DATE '2024-06-30' AS e, 0.5 AS threshold, floor(c_acctbal) / 8192 AS v FROM customer),
h AS (SELECT o_orderkey AS challenger, o_custkey AS model, CASE WHEN o_orderkey % 7 > 0 THEN c_mktsegment ELSE 'OTHER' END AS population, DATE '2024-01-01' AS s, CASE WHEN o_orderkey % 5 > 0 THEN DATE '2024-06-30' ELSE DATE '2024-09-30' END AS e, CASE WHEN o_orderkey % 6 > 0 THEN 0.5 ELSE 0.4 END AS threshold, floor(o_totalprice) / 262144 AS v,
  CASE WHEN o_orderkey % 4 > 0 THEN DATE '2023-12-31' ELSE DATE '2024-02-15' END AS te, o_orderkey % 3 > 0 AS ex FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT h.*, g.v AS cv, h.population = g.population AS p, h.e = g.e AS same_end, h.threshold = g.threshold AS t FROM h JOIN g USING (model))
SELECT challenger, CASE WHEN p AND same_end AND t THEN v - cv END AS lift, concat_ws(',', CASE WHEN NOT p THEN 'other_population' END, CASE WHEN NOT same_end THEN 'other_eval_end' END, CASE WHEN NOT t THEN 'other_threshold' END, CASE WHEN s <= te THEN 'overlaps_training' END,
CASE WHEN p AND same_end AND t AND v - cv <= 0 THEN 'no_lift' END, CASE WHEN NOT ex THEN 'not_explained' END) AS blocking FROM x""")
def model_challengers(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("date")
    c, k = table(spark, sf, "customer"), F.col("o_orderkey")
    champions = c.select(F.col("c_custkey").alias("model"), F.col("c_mktsegment").alias("population"), day("2024-01-01").alias("eval_start"), day("2024-06-30").alias("eval_end"), F.lit(0.5).alias("threshold"), (F.floor("c_acctbal") / 8192).alias("value"))
    new = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("challenger"), F.col("o_custkey").alias("model"), F.when(k % 7 > 0, F.col("c_mktsegment")).otherwise("OTHER").alias("population"), day("2024-01-01").alias("eval_start"), F.when(k % 5 > 0, day("2024-06-30")).otherwise(day("2024-09-30")).alias("eval_end"),
        F.when(k % 6 > 0, 0.5).otherwise(0.4).alias("threshold"), (F.floor("o_totalprice") / 262144).alias("value"), F.when(k % 4 > 0, day("2023-12-31")).otherwise(day("2024-02-15")).alias("train_end"), (k % 3 > 0).alias("explained"),
    )
    return V.challenges(champions, new).select("challenger", "lift", F.array_join("blocking", ",").alias("blocking"))


@query("""SELECT 'all' AS dimension, NULL AS level, count(*) AS n, count(*) >= 100 AS enough FROM documents UNION ALL SELECT 'lang', lang, count(*), count(*) >= 40 FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), count(*) >= 20 FROM documents GROUP BY source""")
def golden_set_admission(spark: SparkSession, sf: str) -> DataFrame:
    return V.admission(table(spark, sf, "documents"), {"lang": 40, "source": 20}, 100)


@query("""WITH t AS (SELECT conv_id, count(*) AS turns, max(CASE WHEN turn >= 3 THEN 1 ELSE 0 END) AS handed FROM conversations GROUP BY 1) SELECT count(*) AS sessions, CAST(sum(handed) AS BIGINT) AS handoffs, round((count(*) - sum(handed)) / CAST(count(*) AS DOUBLE), 6) AS containment, CAST(greatest(ceil(count(*) * 0.02), 1) AS BIGINT) AS audited FROM t""")
def assistant_containment(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max((F.col("turn") >= 3).cast("int")).alias("handed")).agg(F.count("*").alias("sessions"), F.sum("handed").alias("handoffs"))
    return t.select("sessions", "handoffs", F.round(V.containment(F.col("sessions"), F.col("handoffs")), 6).alias("containment"), V.audit_size(F.col("sessions")).cast("bigint").alias("audited"))


@query("""WITH a AS (SELECT o_orderkey AS application, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice / 500000 END AS pd, o_orderpriority = '1-URGENT' AS r1, o_orderstatus = 'P' AS r2 FROM orders)
SELECT application, CASE WHEN r1 THEN 'DECLINE' WHEN r2 THEN 'REFER' WHEN pd IS NULL THEN 'REFER' WHEN pd <= 0.2 THEN 'APPROVE' WHEN pd >= 0.6 THEN 'DECLINE' ELSE 'REFER' END AS outcome, CASE WHEN r1 OR r2 THEN 'policy_rule' WHEN pd IS NULL THEN 'fallback' ELSE 'model' END AS decided_by,
concat_ws(',', CASE WHEN r1 THEN 'urgent' END, CASE WHEN r2 THEN 'pending' END) AS fired FROM a""")
def decisions_online(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rules = {"urgent": (F.col("o_orderpriority") == "1-URGENT", "DECLINE"), "pending": (F.col("o_orderstatus") == "P", "REFER")}
    d = V.decided(rules, F.when(k % 10 > 0, F.col("o_totalprice") / 500000), 0.2, 0.6)
    return table(spark, sf, "orders").select(k.alias("application"), d.alias("d")).select("application", "d.outcome", "d.decided_by", F.array_join("d.fired", ",").alias("fired"))
