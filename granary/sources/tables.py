"""The parquet tables in the roles that the engine gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import credit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def account_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer and month: balance, and days past due from the states of the orders (unknown if all are pending)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.last_day(F.col("o_orderdate").cast("date")).alias("snapshot"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    rank = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    late = F.sum((F.col("o_orderstatus") == "F").cast("int"))
    months = o.groupBy(F.col("o_custkey").alias("account_id"), "snapshot").agg(
        F.when(F.sum((F.col("o_orderstatus") != "P").cast("int")) > 0, 30 * late + F.min(rank)).cast("int").alias("dpd"),
        F.sum(credit.minor_units(F.col("o_totalprice"))).alias("balance"),
    )
    first = F.expr("min(snapshot) over (partition by account_id)")
    return months.select("account_id", "snapshot", credit.month_index(F.col("snapshot")).alias("month_index"), credit.months_between(first, F.col("snapshot")).alias("months_on_book"), "dpd", "balance")


#: The same in SQL, as the start of a query.
ACCOUNT_MONTHS_SQL = """WITH am0 AS (
  SELECT o_custkey AS account_id, last_day(CAST(o_orderdate AS DATE)) AS snapshot,
    CASE WHEN sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) > 0
      THEN CAST(30 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + min(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) AS INTEGER) END AS dpd,
    CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT) AS balance
  FROM orders GROUP BY ALL),
am AS (
  SELECT account_id, snapshot, year(snapshot) * 12 + month(snapshot) AS month_index,
    (year(snapshot) * 12 + month(snapshot)) - min(year(snapshot) * 12 + month(snapshot)) OVER (PARTITION BY account_id) AS months_on_book, dpd, balance
  FROM am0)"""

#: Delinquency bucket in SQL.
BUCKET_SQL = "CASE WHEN {d} IS NULL THEN 'unknown' WHEN {d} = 0 THEN 'current' WHEN {d} <= 30 THEN '1-30' WHEN {d} <= 60 THEN '31-60' WHEN {d} < 90 THEN '61-89' ELSE 'npa' END"


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored rows: id (of order, line and part, since lines repeat), score in (0, 1) with many ties, label, segment, and a challenger's score."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_003 + F.col("l_partkey")).alias("id"),
        (F.col("l_quantity") / 51).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_linestatus").alias("segment"),
        F.pmod(F.col("l_partkey"), F.lit(51)).cast("double").alias("rank2"),
        F.col("l_shipdate").cast("date").alias("day"),
    ).select("id", "score", "label", "segment", ((F.col("rank2") + 0.5) / 51).alias("score2"), "day")


SCORED_SQL = """WITH scored AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey AS id, l_quantity / 51 AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  l_linestatus AS segment, (CAST(l_partkey % 51 AS DOUBLE) + 0.5) / 51 AS score2, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""


def two_clock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a second clock: arrival some minutes after the event, every 50th two hours late."""
    e = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 50 == 0, 120).otherwise(F.col("event_id") % 17)
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id"), F.col("user_id").alias("key"), "event_type", "value", ts.alias("event_time"), (ts + F.make_dt_interval(mins=late.cast("int"))).alias("ingest_time"))


TWO_CLOCK_SQL = """WITH ev AS (SELECT event_id, user_id AS key, event_type, value, ts AS event_time,
  ts + to_minutes(CASE WHEN event_id % 50 = 0 THEN 120 ELSE event_id % 17 END) AS ingest_time FROM events)"""
