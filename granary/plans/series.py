"""Series queries over daily and monthly events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import series as S
from granary.plans.registry import query
from granary.plans.scoring import rounded
from granary.sources.tables import table

DAILY = "WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS moment, count(*) AS n, round(sum(value), 2) AS x FROM events GROUP BY ALL)"
USERS = "WITH d AS (SELECT user_id AS series, CAST(ts AS DATE) AS moment, round(avg(value), 4) AS x, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("moment")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("x"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type = 'purchase'")
    return e.groupBy(F.col("user_id").alias("series"), F.col("ts").cast("date").alias("moment")).agg(F.round(F.avg("value"), 4).alias("x"), F.count("*").alias("n"))


@query(f"""{DAILY}, p AS (SELECT series, moment, n, sum((n - 65) / 8.0 - 0.5) OVER (PARTITION BY series ORDER BY moment ROWS UNBOUNDED PRECEDING) AS p FROM d)
SELECT series, moment, n, round(p - least(0, min(p) OVER (PARTITION BY series ORDER BY moment ROWS UNBOUNDED PRECEDING)), 6) AS cusum, p - least(0, min(p) OVER (PARTITION BY series ORDER BY moment ROWS UNBOUNDED PRECEDING)) > 4.05 AS alarm FROM p""")
def series_cusum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.cusum(daily(spark, sf).drop("x"), (F.col("n") - 65) / 8.0, 0.5, 4.05), "cusum")


@query(f"""{USERS}, r AS (SELECT *, CAST(x < 150 AS INTEGER) AS low, row_number() OVER (PARTITION BY series ORDER BY moment) AS i FROM d),
i AS (SELECT *, i - sum(low) OVER (PARTITION BY series ORDER BY moment ROWS UNBOUNDED PRECEDING) AS island FROM r), e AS (SELECT series, moment, row_number() OVER (PARTITION BY series, island ORDER BY moment) AS len FROM i WHERE low = 1)
SELECT series, min(moment) AS fired FROM e WHERE len = 2 GROUP BY 1""")
def series_stress_run(spark: SparkSession, sf: str) -> DataFrame:
    return S.stress_run(users(spark, sf), 150, 2)


@query(f"{USERS}, g AS (SELECT series, date_diff('day', moment, lead(moment) OVER (PARTITION BY series ORDER BY moment)) AS gap FROM d) SELECT series, max(gap) AS longest_gap, count(*) AS n FROM g GROUP BY 1")
def series_longest_gap(spark: SparkSession, sf: str) -> DataFrame:
    return S.longest_gap(users(spark, sf))


@query(f"""{USERS}, g AS (SELECT series, arg_max(x, moment) FILTER (moment <= DATE '2024-01-15') AS ax, max(moment) FILTER (moment <= DATE '2024-01-15') AS aa, arg_min(x, moment) FILTER (moment >= DATE '2024-01-15') AS bx, min(moment) FILTER (moment >= DATE '2024-01-15') AS ba FROM d GROUP BY 1)
SELECT series, round(CASE WHEN aa = ba THEN ax WHEN date_diff('day', aa, ba) <= 30 THEN ax + (bx - ax) * date_diff('day', aa, DATE '2024-01-15') / date_diff('day', aa, ba) END, 6) AS value, coalesce(aa = ba, false) AS exact FROM g""")
def series_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(S.interpolated(users(spark, sf), F.lit("2024-01-15").cast("date")), "value")
    return out.withColumn("exact", F.coalesce("exact", F.lit(False)))


@query(f"""{USERS}, w AS (SELECT series, moment, x, date_diff('day', min(moment) OVER (PARTITION BY series), moment) AS day, (lead(x) OVER o + x) / 2 * date_diff('day', moment, lead(moment) OVER o) AS area FROM d WINDOW o AS (PARTITION BY series ORDER BY moment)),
k AS (SELECT series, arg_min(day, struct_pack(a := -x, b := day)) AS pd FROM w GROUP BY 1), j AS (SELECT * FROM w JOIN k USING (series))
SELECT series, max(x) AS peak, round(avg(x), 6) AS mean, min(x) AS low, round(max(x) - min(x), 6) AS amplitude, round(sum(area), 4) AS integral, max(pd) AS days_to_peak,
 round(nullif(regr_slope(x, day) FILTER (day <= pd), CAST('NaN' AS DOUBLE)), 5) AS green_up, round(nullif(regr_slope(x, day) FILTER (day >= pd), CAST('NaN' AS DOUBLE)), 5) AS senescence, count(*) AS n FROM j GROUP BY series HAVING count(*) >= 3""")
def series_phenology(spark: SparkSession, sf: str) -> DataFrame:
    out = S.phenology(users(spark, sf))
    return rounded(rounded(rounded(out, "mean", "amplitude"), "integral", digits=4), "green_up", "senescence", digits=5)


@query(f"{DAILY} SELECT series, moment, n, x, round(CASE WHEN row_number() OVER o >= 3 THEN sum(x) OVER (PARTITION BY series ORDER BY moment ROWS 2 PRECEDING) END, 2) AS accumulated FROM d WINDOW o AS (PARTITION BY series ORDER BY moment)")
def series_accumulated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.accumulated(daily(spark, sf), 3), "accumulated", digits=2)


@query(f"""{DAILY}, g AS (SELECT series AS period, avg(x) FILTER (x > 0) AS m, avg(CASE WHEN x > 0 THEN ln(x) END) AS l, 1 - count(*) FILTER (x > 0) / CAST(count(*) AS DOUBLE) AS zero FROM d GROUP BY 1),
s AS (SELECT *, (1 + sqrt(1 + 4 * (ln(m) - l) / 3)) / (4 * (ln(m) - l)) AS shape FROM g) SELECT period, round(shape, 4) AS shape, round(m / shape, 4) AS scale, zero FROM s""")
def series_gamma_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.gamma_parameters(daily(spark, sf), F.col("series")), "shape", "scale", digits=4)


_VELOCITY = f"""{USERS}, c AS (SELECT series, moment, x, x - lag(x) OVER o AS change, date_diff('day', lag(moment) OVER o, moment) AS gap FROM d WINDOW o AS (PARTITION BY series ORDER BY moment)), v AS (SELECT series, moment, round(change, 4) AS change FROM c WHERE gap BETWEEN 1 AND 5)"""


@query(f"{_VELOCITY} SELECT series, moment, change, round((rank() OVER (PARTITION BY moment ORDER BY change) - 1) / CAST(count(*) OVER (PARTITION BY moment) AS DOUBLE), 6) AS percentile FROM v")
def series_velocity_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    v = rounded(S.velocity(users(spark, sf), 3, 2), "change", digits=4).select("series", "moment", "change")
    return rounded(S.share_below(v, "change", "moment"), "percentile")


@query(f"""{DAILY}, p AS (SELECT series, x, (row_number() OVER (PARTITION BY series ORDER BY moment) - 1) % 7 AS place FROM d), m AS (SELECT series, place, median(x) AS m FROM p GROUP BY ALL)
SELECT series, CAST(place AS INTEGER) AS place, round(m - avg(m) OVER (PARTITION BY series), 4) AS component FROM m""")
def series_seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.seasonal(daily(spark, sf), 7), "component", digits=4)


@query(f"""{DAILY}, f AS (SELECT series, x - lag(x) OVER (PARTITION BY series ORDER BY moment) AS d FROM d), c AS (SELECT series, d, median(d) OVER (PARTITION BY series) AS c FROM f WHERE d IS NOT NULL)
SELECT series, round(median(abs(d - c)) * 1.4826 / sqrt(2.0), 4) AS scale FROM c GROUP BY 1""")
def series_local_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.local_scale(daily(spark, sf)), "scale", digits=4)


@query("""WITH m AS (SELECT user_id AS series, CAST(date_trunc('day', ts) AS DATE) AS moment, CAST(sum(event_id % 7) AS BIGINT) AS credits, CAST(sum(event_id % 5) AS BIGINT) AS debits FROM events GROUP BY ALL),
o AS (SELECT *, coalesce(CAST(sum(credits - debits) OVER (PARTITION BY series ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS opening FROM m),
s AS (SELECT series, moment, opening, credits, debits, opening + credits - debits + CASE WHEN (series + day(moment)) % 23 = 0 THEN 1 ELSE 0 END AS closing FROM o)
SELECT *, opening + credits - debits <> closing AS arithmetic, coalesce(lead(opening) OVER (PARTITION BY series ORDER BY moment) <> closing, false) AS continuity FROM s""")
def series_balance_continuity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("series"), F.col("ts").cast("date").alias("moment")).agg(F.sum(F.col("event_id") % 7).alias("credits"), F.sum(F.col("event_id") % 5).alias("debits"))
    opening = F.coalesce(F.sum(F.col("credits") - F.col("debits")).over(S.ordered().rowsBetween(-(1 << 31), -1)), F.lit(0))
    e = e.withColumn("opening", opening)
    slip = F.when((F.col("series") + F.day("moment")) % 23 == 0, 1).otherwise(0)
    return S.balance_breaks(e.withColumn("closing", F.col("opening") + F.col("credits") - F.col("debits") + slip))


@query(f"""{USERS}, e AS (SELECT DISTINCT series, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 3 DAY)) AS moment FROM d)
SELECT series, count(*) AS expected, count(d.moment) AS seen, round(count(d.moment) / CAST(count(*) AS DOUBLE), 6) AS completeness FROM e LEFT JOIN d USING (series, moment) GROUP BY 1""")
def series_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.completeness(users(spark, sf), "2024-01-01", "2024-01-30", 3), "completeness")
