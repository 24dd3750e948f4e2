"""Queries over agricultural triggers, leads, climate histories, calibration drift and reranking."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import retrieval as R
from granary.operators import series as S
from granary.operators import triggers as T
from granary.plans.documents import VEC, dense
from granary.plans.registry import query
from granary.plans.scoring import rounded
from granary.plans.series import DAILY, daily
from granary.sources.tables import table

_FIRED = """WITH i AS (SELECT CAST(c_custkey AS VARCHAR) AS subject, CAST(c_nationkey AS VARCHAR) AS district FROM customer WHERE c_custkey % 3 > 0),
d AS (SELECT CAST(n_nationkey AS VARCHAR) AS subject, n_nationkey % 7 / 2.0 - 2.5 AS value FROM nation WHERE n_nationkey % 7 / 2.0 - 2.5 <= -1.5)
SELECT 'non_sowing' AS trigger, 'individual' AS scope, subject, DATE '2024-07-20' AS observed, 10 AS days, NULL::DOUBLE AS value, district IN (SELECT subject FROM d) AS suppressed FROM i UNION ALL SELECT 'district_drought', 'district', subject, DATE '2024-07-15', NULL, value, false FROM d"""


@query(_FIRED)
def trigger_routing(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    plots = c.select(F.col("c_custkey").alias("plot"), F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False).alias("sowing_observed"))
    dry = table(spark, sf, "nation").select(F.col("n_nationkey").alias("district"), F.lit("2024-07-15").alias("observed"), F.lit(3).alias("timescale"), (F.col("n_nationkey") % 7 / 2 - 2.5).alias("value"))
    fired = T.non_sowing(plots, datetime.date(2024, 7, 20), datetime.date(2024, 7, 10)).unionByName(T.district_drought(dry, -1.5))
    return T.routed(fired, c.select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("district")))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'suppress_marketing' WHEN 'MACHINERY' THEN 'offer' WHEN 'FURNITURE' THEN 'offer' ELSE 'none' END AS action, CASE c_mktsegment WHEN 'MACHINERY' THEN 'seed,fertiliser' WHEN 'FURNITURE' THEN 'tractor' ELSE '' END AS products FROM customer""")
def trigger_season_actions(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("c_mktsegment")
    stage = F.when(m == "BUILDING", "drought_flagged").when(m == "MACHINERY", "sowing_confirmed").when(m == "FURNITURE", "good_harvest")
    a = T.season_action(stage, ["seed", "fertiliser"], ["tractor"])
    return table(spark, sf, "customer").select("c_custkey", a.alias("a")).select("c_custkey", "a.action", F.array_join("a.products", ",").alias("products"))


@query("""WITH d AS (SELECT CASE WHEN l_linenumber % 4 > 0 THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS lead FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS defaults, count(*) FILTER (lead >= 45) AS in_time, count(*) FILTER (lead < 45) AS late, count(*) FILTER (lead IS NULL) AS never, median(lead) AS median_lead FROM d""")
def trigger_leads(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = l.select(F.col("l_shipdate").cast("date").alias("defaulted"), F.when(F.col("l_linenumber") % 4 > 0, F.col("o_orderdate").cast("date")).alias("flagged"))
    return T.lead_summary(d, 45)


@query("""SELECT c_custkey AS borrower, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'plot' WHEN c_nationkey < 12 THEN 'village' END AS granularity FROM customer""")
def plot_granularity(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    plots = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("borrower"))
    return T.granularity(c.select(F.col("c_custkey").alias("borrower")), plots, c.filter("c_nationkey < 12").select(F.col("c_custkey").alias("borrower")))


@query(f"""{DAILY}, z AS (SELECT series, moment, round((n % 13) / 3.0 - 2, 4) AS z, row_number() OVER (PARTITION BY series ORDER BY moment DESC) AS r FROM d), g AS (SELECT series, count(*) AS seasons, avg(CASE WHEN z <= -1 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN z >= 1 THEN 1.0 ELSE 0 END) AS b, avg(z) AS m, min(z) AS w FROM z WHERE r <= 10 GROUP BY 1)
SELECT series, seasons, round(CASE WHEN seasons = 10 THEN a END, 6) AS drought, round(CASE WHEN seasons = 10 THEN b END, 6) AS excess_rain, round(CASE WHEN seasons = 10 THEN m END, 6) AS mean, CASE WHEN seasons = 10 THEN w END AS worst FROM g""")
def climate_features(spark: SparkSession, sf: str) -> DataFrame:
    h = daily(spark, sf).select("series", "moment", F.round(F.col("n") % 13 / 3 - 2, 4).alias("z"))
    return rounded(T.climate(h, 10), "drought", "excess_rain", "mean")


@query(f"""{DAILY}, z AS (SELECT series, moment, 0.2 AS expected, n % 9 AS bads, n % 9 + 20 AS accounts FROM d), y AS (SELECT *, (bads / CAST(accounts AS DOUBLE) - expected) / sqrt(expected * (1 - expected) / accounts) AS z FROM z),
p AS (SELECT *, sum(z - 0.25) OVER w AS u, sum(-z - 0.25) OVER w AS d FROM y WINDOW w AS (PARTITION BY series ORDER BY moment ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, u - least(min(u) OVER w, 0) AS upper, d - least(min(d) OVER w, 0) AS lower FROM p WINDOW w AS (PARTITION BY series ORDER BY moment ROWS UNBOUNDED PRECEDING))
SELECT series, moment, round(upper, 5) AS upper, round(lower, 5) AS lower, CASE WHEN upper > 3 THEN 'under_predicting' WHEN lower > 3 THEN 'over_predicting' END AS alarm FROM q""")
def series_calibration_drift(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).select("series", "moment", F.lit(0.2).alias("expected"), (F.col("n") % 9).alias("bads"), (F.col("n") % 9 + 20).alias("accounts"))
    return rounded(S.calibration_drift(d, 0.25, 3.0).select("series", "moment", "upper", "lower", "alarm"), "upper", "lower", digits=5)


@query(f"""WITH {VEC}, tx AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w FROM part), cand AS (SELECT query, chunk, len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) AS s FROM dr JOIN tx a ON a.id = query + 1 LEFT JOIN tx b ON b.id = chunk + 1 WHERE rank <= 20),
rr AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY coalesce(round(s, 9), -1) DESC, chunk) AS rank FROM cand) SELECT query, chunk, CAST(rank AS INTEGER) AS rank FROM rr WHERE rank <= 5""")
def retrieval_reranked(spark: SparkSession, sf: str) -> DataFrame:
    """Dense candidates in the order of their shared words."""
    p = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("id"), "p_name")
    words = lambda c: F.split(c, " ")
    a, b = words("query_text"), words("passage")
    score = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    score = F.when(F.col("passage").isNotNull(), score)
    return R.reranked(dense(spark, sf, 20), p.select(F.col("id").alias("query"), F.col("p_name").alias("query_text")), p.select(F.col("id").alias("chunk"), F.col("p_name").alias("passage")), score, 5).select("query", "chunk", "rank")
