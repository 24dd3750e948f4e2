"""Ordered-series operators. A series has columns series, moment (a date or number) and x; every window is within one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def ordered():
    """A series in order."""
    return Window.partitionBy("series").orderBy("moment")


def past():
    """A series up to this row."""
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    """A series in no order."""
    return Window.partitionBy("series")


def cusum(df: DataFrame, z: Column, k: float, h: float) -> DataFrame:
    """One-sided CUSUM max(0, S + z - k) in closed form, and whether it exceeds h."""
    p = df.withColumn("p", F.sum(z - k).over(past()))
    s = F.col("p") - F.least(F.lit(0.0), F.min("p").over(past()))
    return p.withColumn("cusum", s).withColumn("alarm", s > h).drop("p")


def stress_run(df: DataFrame, threshold: float, consecutive: int) -> DataFrame:
    """Per series the end of the first run of ``consecutive`` values below the threshold."""
    low = (F.col("x") < threshold).cast("int")
    runs = df.withColumn("low", low).withColumn("n", F.row_number().over(ordered())).withColumn("island", F.col("n") - F.sum("low").over(past())).filter("low = 1")
    ends = runs.withColumn("length", F.row_number().over(Window.partitionBy("series", "island").orderBy("moment"))).filter(F.col("length") == consecutive)
    return ends.groupBy("series").agg(F.min("moment").alias("fired"))


def longest_gap(df: DataFrame) -> DataFrame:
    """Per series the most days between neighbours."""
    return df.withColumn("gap", F.datediff(F.lead("moment").over(ordered()), "moment")).groupBy("series").agg(F.max("gap").alias("longest_gap"), F.count("*").alias("n"))


def interpolated(df: DataFrame, target: Column, max_gap: int = 30) -> DataFrame:
    """Per series the value at a date: exact, or linear between neighbours at most ``max_gap`` days apart, else null."""
    d = df.withColumn("t", target)
    before, after = F.col("moment") <= F.col("t"), F.col("moment") >= F.col("t")
    g = d.groupBy("series", "t").agg(F.max_by(F.struct("moment", "x"), F.when(before, F.col("moment"))).alias("a"), F.min_by(F.struct("moment", "x"), F.when(after, F.col("moment"))).alias("b"), F.count(F.when(before, 1)).alias("na"), F.count(F.when(after, 1)).alias("nb"))
    a, b = F.col("a"), F.col("b")
    gap = F.datediff(b["moment"], a["moment"])
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    value = F.when(both & (gap == 0), a["x"]).when(both & (gap <= max_gap), a["x"] + (b["x"] - a["x"]) * F.datediff(F.col("t"), a["moment"]) / gap)
    return g.select("series", value.alias("value"), (both & (gap == 0)).alias("exact"))


def phenology(df: DataFrame, least: int = 3) -> DataFrame:
    """Peak, mean, minimum, amplitude, trapezoid integral, days to peak, slopes up to and from the peak, count; series with fewer than ``least`` values are left out."""
    day = F.datediff("moment", F.min("moment").over(whole()))
    d = df.withColumn("day", day).withColumn("peak_day", F.min_by("day", F.struct(-F.col("x"), "day")).over(whole()))
    d = d.withColumn("area", (F.lead("x").over(ordered()) + F.col("x")) / 2 * F.datediff(F.lead("moment").over(ordered()), "moment"))
    up, down = F.col("day") <= F.col("peak_day"), F.col("day") >= F.col("peak_day")
    slope = lambda c: F.regr_slope(F.when(c, F.col("x")), F.when(c, F.col("day").cast("double")))
    out = d.groupBy("series").agg(F.max("x").alias("peak"), F.avg("x").alias("mean"), F.min("x").alias("low"), (F.max("x") - F.min("x")).alias("amplitude"), F.sum("area").alias("integral"), F.max("peak_day").alias("days_to_peak"), slope(up).alias("green_up"), slope(down).alias("senescence"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least)


def accumulated(df: DataFrame, k: int) -> DataFrame:
    """Sum of the last k values; null for the first k - 1."""
    return df.withColumn("accumulated", F.when(F.row_number().over(ordered()) >= k, F.sum("x").over(ordered().rowsBetween(-(k - 1), 0))))


def gamma_parameters(df: DataFrame, by: Column) -> DataFrame:
    """Thom's gamma fit to the positive values of each group, in closed form, and the share of zeros."""
    x = F.when(F.col("x") > 0, F.col("x"))
    g = df.filter("x is not null").groupBy(by.alias("period")).agg(F.avg(x).alias("m"), F.avg(F.log(x)).alias("l"), (1 - F.count(x) / F.count("*")).alias("zero"))
    a = F.log("m") - F.col("l")
    shape = (1 + F.sqrt(1 + 4 * a / 3)) / (4 * a)
    return g.select("period", shape.alias("shape"), (F.col("m") / shape).alias("scale"), "zero")


def velocity(df: DataFrame, days: int = 30, tolerance: int = 5) -> DataFrame:
    """Change from the row before, if it lies ``days`` back, give or take the tolerance."""
    gap = F.datediff("moment", F.lag("moment").over(ordered()))
    return df.withColumn("change", F.when(gap.between(days - tolerance, days + tolerance), F.col("x") - F.lag("x").over(ordered()))).filter("change is not null")


def share_below(df: DataFrame, value: str, by: str) -> DataFrame:
    """Share of the group's values strictly below, from counts per value."""
    g = df.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(by, value, ((F.sum("n").over(w) - F.col("n")) / F.sum("n").over(Window.partitionBy(by))).alias("percentile"))
    return df.join(g, [by, value])


def seasonal(df: DataFrame, period: int) -> DataFrame:
    """Median by position in the period, centred on the mean of the medians."""
    place = F.pmod(F.row_number().over(ordered()) - 1, F.lit(period))
    m = df.withColumn("place", place).groupBy("series", "place").agg(F.median("x").alias("m"))
    return m.select("series", "place", (F.col("m") - F.avg("m").over(whole())).alias("component"))


def local_scale(df: DataFrame) -> DataFrame:
    """1.4826 / sqrt(2) times the median absolute deviation of first differences."""
    d = df.withColumn("d", F.col("x") - F.lag("x").over(ordered())).filter("d is not null")
    c = d.withColumn("c", F.median("d").over(whole()))
    return c.groupBy("series").agg((F.median(F.abs(F.col("d") - F.col("c"))) * 1.4826 / 2**0.5).alias("scale"))


def balance_breaks(df: DataFrame) -> DataFrame:
    """Statement months (series, moment, opening, credits, debits, closing) that do not add up, or whose closing is not the next opening."""
    sums = F.col("opening") + F.col("credits") - F.col("debits") != F.col("closing")
    carried = F.lead("opening").over(ordered()) != F.col("closing")
    return df.withColumn("arithmetic", sums).withColumn("continuity", F.coalesce(carried, F.lit(False)))


def completeness(received: DataFrame, start: str, end: str, every: int) -> DataFrame:
    """Per series: expected days, days seen among them, and the share. received: series, moment."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {every} days"))).alias("moment")
    expected = received.select("series").distinct().select("series", days)
    seen = received.select("series", "moment").distinct().withColumn("seen", F.lit(1))
    return expected.join(seen, ["series", "moment"], "left").groupBy("series").agg(F.count("*").alias("expected"), F.count("seen").alias("seen"), F.avg(F.coalesce("seen", F.lit(0))).alias("completeness"))


def calibration_drift(df: DataFrame, shift: float, interval: float) -> DataFrame:
    """Two-sided CUSUM of observed against expected rates, with the side that alarms. Rows: series, moment, expected, bads, accounts.

    max(0, S + step) from zero is the running sum less its least value so far,
    so both sides are windows; periods without accounts are left out.
    """
    d = df.filter("accounts > 0 and expected between 0 and 1").withColumn("observed", F.col("bads") / F.col("accounts"))
    se = F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("accounts"))
    z = F.coalesce((F.col("observed") - F.col("expected")) / F.when(se > 0, se), F.lit(0.0))
    d = d.withColumn("up_", F.sum(z - shift).over(past())).withColumn("down_", F.sum(-z - shift).over(past()))
    side = lambda c: F.col(c) - F.least(F.min(c).over(past()), F.lit(0.0))
    d = d.withColumn("upper", side("up_")).withColumn("lower", side("down_")).drop("up_", "down_")
    return d.withColumn("alarm", F.when(F.col("upper") > interval, "under_predicting").when(F.col("lower") > interval, "over_predicting"))
