"""Scenes, composites, lags and drought over observation series (series, day, value, valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scene classes whose pixels say nothing of the ground: no data, saturated, cloud shadow, clouds of medium and high probability, thin cirrus, snow.
UNUSABLE = (0, 1, 3, 8, 9, 10, 11)


def masked(observations: DataFrame, scene_class: str = "scene_class", unusable: tuple[int, ...] = UNUSABLE) -> DataFrame:
    """Observations that stay valid: those in a usable scene class. An unknown class is unusable."""
    usable = F.coalesce(~F.col(scene_class).isin(*unusable), F.lit(False))
    return observations.withColumn("valid", F.coalesce(F.col("valid"), F.lit(False)) & usable)


def composite(observations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Greatest valid value of each series from start to end; series without one are absent."""
    return observations.filter(F.col("valid") & F.col("day").between(start, end)).groupBy("series").agg(F.max("value").alias("composite"), F.count("*").alias("observations"))


def lag_percentiles(records: DataFrame, qs: list[float]) -> DataFrame:
    """(q, lag): nearest-rank percentiles of the days from observation to ingestion."""
    from granary.functions.policy import publication_lag
    from granary.operators.joins import nearest_rank_of

    return nearest_rank_of(records.select(publication_lag(F.col("observed"), F.col("ingested")).alias("lag")), "lag", qs).withColumnRenamed("value", "lag")


def drought_frequency(indices: DataFrame, seasons: int) -> DataFrame:
    """Share of each series' last ``seasons`` index values at or below -1. A series with fewer fails the run: a shorter window is another statistic."""
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("moment")))
    g = indices.filter("z is not null").withColumn("place", place).filter(F.col("place") <= seasons).groupBy("series").agg(F.count("*").alias("n"), F.avg((F.col("z") <= -1).cast("double")).alias("f"))
    return g.select("series", F.when(F.col("n") == seasons, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few seasons for "), F.col("series").cast("string"))).cast("double")).alias("frequency"))


#: Coefficients of a rational approximation of the normal quantile: numerators and denominators of its middle and its tails.
MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
LOW = 0.02425


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution by a rational approximation, within 2e-9 relative."""

    def poly(c: tuple[float, ...], x: Column) -> Column:
        out = F.lit(c[0])
        for a in c[1:]:
            out = out * x + a
        return out

    tail = lambda q: poly(TAIL[0], q) / poly(TAIL[1], q)
    r = (p - 0.5) * (p - 0.5)
    middle = (p - 0.5) * poly(MIDDLE[0], r) / poly(MIDDLE[1], r)
    return F.when(p < LOW, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - LOW, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def standardised(probability: Column, limit: float = 3.09) -> Column:
    """Normal score of a cumulative probability, within the limit."""
    z = normal_quantile(F.least(F.greatest(probability, F.lit(1e-10)), F.lit(1 - 1e-10)))
    return F.when(probability.isNotNull(), F.least(F.greatest(z, F.lit(-limit)), F.lit(limit)))


def enough_years(sums: DataFrame, value: str, by: list[str], least: int) -> DataFrame:
    """The rows, if every group (series and calendar month) has values of ``least`` years; else the run fails, as an index of fewer years is another one."""
    n = F.count(value).over(Window.partitionBy(*by))
    bad = F.raise_error(F.concat_ws(" ", F.lit("too few years for"), *[F.col(b).cast("string") for b in by])).cast("boolean")
    return sums.withColumn("enough_", F.when(n >= least, True).otherwise(bad)).filter("enough_").drop("enough_")


def described_change(series: DataFrame, changes: DataFrame) -> DataFrame:
    """Means of the observed values before and from a change. series: series, place (from 0), value. changes: series, at.

    A change at the first or beyond the last place is no change and has null means.
    """
    c = changes.select(F.col("series").alias("s_"), "at")
    side = lambda cond: F.avg(F.when(cond, F.col("value")))
    g = series.join(c, F.col("series") == F.col("s_")).groupBy("series", "at").agg(side(F.col("place") < F.col("at")).alias("before"), side(F.col("place") >= F.col("at")).alias("after"))
    inside = F.col("before").isNotNull() & F.col("after").isNotNull()
    return g.select("series", "at", F.when(inside, F.col("before")).alias("mean_before"), F.when(inside, F.col("after")).alias("mean_after"))


def agri_backtest(quartiles: DataFrame, uplift: Column, leads: DataFrame) -> DataFrame:
    """One row of the three tests: whether default rates fall over the quartiles of land quality, the gain in points, and the share of defaults flagged in time.

    quartiles: slice, rate. leads: one row of ``triggers.lead_summary``.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("slice")
    steps = quartiles.select((F.col("rate") - F.lag("rate").over(w)).alias("d"))
    one = steps.agg(F.coalesce(F.every(F.col("d") <= 0), F.lit(False)).alias("monotone"))
    share = F.col("in_time") / F.when(F.col("defaults") > 0, F.col("defaults"))
    return one.crossJoin(F.broadcast(leads)).select("monotone", uplift["points"].alias("uplift_points"), uplift["counts"].alias("uplift_counts"), share.alias("in_time_share"), "median_lead")
