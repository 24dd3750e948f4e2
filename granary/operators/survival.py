"""Product-limit estimators, cumulative incidence and concordance, over rows (time, event or cause).

Subjects are first counted by time; what is windowed then has one row per
distinct time, in months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    """Times in order: distinct times are few, so one task may hold them."""
    return Window.partitionBy(F.lit(0)).orderBy("time")


def at_risk(subjects: DataFrame, *counts: Column) -> DataFrame:
    """Per time: counts of events and the subjects still at risk."""
    counted = subjects.groupBy("time").agg(F.count("*").alias("n"), *counts)
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(0))
    return counted.withColumn("at_risk", F.sum("n").over(total) - F.coalesce(F.sum("n").over(before), F.lit(0)))


def product_limit(subjects: DataFrame, event: Column) -> DataFrame:
    """Steps (time, survival) at the times of events."""
    t = at_risk(subjects, F.sum(event.cast("int")).alias("d")).filter("d > 0")
    past = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return t.select("time", "at_risk", "d", F.product(1 - F.col("d") / F.col("at_risk")).over(past).alias("survival"))


def kaplan_meier(subjects: DataFrame) -> DataFrame:
    return product_limit(subjects, F.col("cause") == 1)


def censoring_survival(subjects: DataFrame) -> DataFrame:
    return product_limit(subjects, F.col("cause") == 0)


def cumulative_incidence(subjects: DataFrame) -> DataFrame:
    """Per time: cause-specific hazards, cumulative incidence of causes 1 and 2, and the naive 1 - survival of cause 1 alone."""
    t = at_risk(subjects, *[F.sum((F.col("cause") == k).cast("int")).alias(f"d{k}") for k in (1, 2)])
    h1, h2 = F.col("d1") / F.col("at_risk"), F.col("d2") / F.col("at_risk")
    before, past = by_time().rowsBetween(Window.unboundedPreceding, -1), by_time().rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("alive", F.coalesce(F.product(1 - h1 - h2).over(before), F.lit(1.0))).withColumn("naive", 1 - F.product(1 - h1).over(past))
    return t.select("time", "at_risk", "d1", "d2", F.sum(F.col("alive") * h1).over(past).alias("cif1"), F.sum(F.col("alive") * h2).over(past).alias("cif2"), "naive")


def brier_at(subjects: DataFrame, survival: float, t: int) -> DataFrame:
    """Brier score at ``t`` of one predicted survival, weighted by the inverse probability of not being censored."""
    steps = censoring_survival(subjects).select(F.col("time").alias("at"), "survival")
    at_t = F.coalesce(F.max_by(F.when(F.col("at") <= t, F.col("survival")), F.when(F.col("at") <= t, F.col("at"))), F.lit(1.0))
    g = steps.agg(at_t.alias("g_t"))
    counted = subjects.groupBy("time", "cause").agg(F.count("*").alias("n"))
    # G just before each event time: times are few, so the steps are matched by range.
    before = counted.join(steps, steps["at"] < counted["time"], "left").groupBy("time", "cause", "n").agg(F.coalesce(F.max_by("survival", "at"), F.lit(1.0)).alias("g")).crossJoin(F.broadcast(g))
    early = (F.col("time") <= t) & (F.col("cause") == 1)
    term = F.when(early, survival**2 / F.col("g")).when(F.col("time") > t, (1 - survival) ** 2 / F.col("g_t")).otherwise(0.0)
    return before.agg((F.sum(term * F.col("n")) / F.sum("n")).alias("brier"))


def concordance(subjects: DataFrame, risk: Column) -> DataFrame:
    """Harrell's c: pairs in which the earlier event has the higher risk; ties in risk count half.

    Subjects are counted by (time, event, risk). For each time of an event,
    one running sum over the risks counts the rows later than it below and at a
    risk: the work grows with times by distinct risks, not with pairs. Times
    are few (months).
    """
    c = subjects.select("time", (F.col("cause") == 1).alias("event"), risk.alias("risk")).groupBy("time", "event", "risk").agg(F.count("*").alias("n"))
    times = c.filter("event").select(F.col("time").alias("t")).distinct()
    met = c.join(F.broadcast(times), F.col("time") >= F.col("t"))
    later = (F.col("time") > F.col("t")) | ~F.col("event")
    by_risk = met.groupBy("t", "risk").agg(F.sum(F.when(later, F.col("n")).otherwise(0)).alias("others"), F.sum(F.when(~later, F.col("n")).otherwise(0)).alias("n"))
    w = Window.partitionBy("t")
    below = F.sum("others").over(w.orderBy("risk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("others")
    x = by_risk.select("n", "others", below.alias("below"), F.sum("others").over(w).alias("all"))
    return x.agg(F.sum(F.col("n") * F.col("all")).alias("comparable"), F.sum(F.col("n") * F.col("below")).alias("concordant"), F.sum(F.col("n") * F.col("others")).alias("tied")).withColumn("c", (F.col("concordant") + 0.5 * F.col("tied")) / F.col("comparable"))


def _survival_before(values: DataFrame, steps: DataFrame, at: Column, name: str) -> DataFrame:
    """``values`` with the step function's value before ``at``, 1 before its first step. Both sides are distinct times in months."""
    s = steps.select(F.col("time").alias("at_"), F.col("survival").alias("s_"))
    kept = values.columns
    return values.join(s, s["at_"] < at, "left").groupBy(*kept).agg(F.coalesce(F.max_by("s_", "at_"), F.lit(1.0)).alias(name))


def time_dependent_auc(subjects: DataFrame, risk: Column, times: list[int]) -> DataFrame:
    """(t, auc): cases by t against those event-free after it, cases weighted by the inverse of staying uncensored up to their event.

    Subjects are counted by (time, event, risk); for each horizon the controls
    below and at a risk come from one running sum over distinct risks. Null
    without cases or controls.
    """
    c = subjects.select("time", (F.col("cause") == 1).alias("event"), risk.cast("double").alias("risk")).groupBy("time", "event", "risk").agg(F.count("*").alias("n"))
    g = _survival_before(c.filter("event").select("time").distinct(), censoring_survival(subjects), F.col("time"), "g")
    c = c.join(F.broadcast(g), "time", "left")
    t = c.withColumn("t", F.explode(F.array(*map(F.lit, times))))
    case = F.when(F.col("event") & (F.col("time") <= F.col("t")) & (F.col("g") > 0), F.col("n") / F.col("g"))
    by_risk = t.groupBy("t", "risk").agg(F.coalesce(F.sum(case), F.lit(0.0)).alias("w"), F.sum(F.when(F.col("time") > F.col("t"), F.col("n")).otherwise(0)).alias("controls"))
    w = Window.partitionBy("t")
    below = F.sum("controls").over(w.orderBy("risk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("controls")
    x = by_risk.withColumn("wins", F.col("w") * (below + F.col("controls") / 2))
    pairs = F.sum("w") * F.sum("controls")
    return x.groupBy("t").agg((F.sum("wins") / F.when(pairs > 0, pairs)).alias("auc"))


def calibration_at(subjects: DataFrame, predicted: Column, t: int, buckets: int = 10) -> DataFrame:
    """(bucket, n, predicted, observed): mean predicted survival against the product-limit estimate within each bucket.

    Buckets take equal numbers of subjects by prediction and are extended
    through ties; their edges come from counts per distinct prediction.
    """
    from granary.operators import fits
    from granary.operators.kernels import tie_extended_bins

    s = subjects.select("time", "cause", predicted.cast("double").alias("score"))
    g = fits.grouped_scores(s.withColumn("label", F.lit(0)))
    if g.empty:
        return s.sparkSession.createDataFrame([], "bucket int, n bigint, predicted double, observed double")
    g["bucket"] = tie_extended_bins(g["score"].to_numpy(), g["n"].to_numpy(), buckets)
    tops = g.groupby("bucket")["score"].max().tolist()
    bucket = sum([(F.col("score") > e).cast("int") for e in tops[:-1]], F.lit(1))
    b = s.withColumn("bucket", bucket)
    n = b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("score").alias("predicted"))
    c = b.groupBy("bucket", "time").agg(F.count("*").alias("m"), F.sum((F.col("cause") == 1).cast("int")).alias("d"))
    w = Window.partitionBy("bucket").orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    steps = c.withColumn("risk", F.sum("m").over(w)).filter((F.col("d") > 0) & (F.col("time") <= t)).groupBy("bucket").agg(F.product(1 - F.col("d") / F.col("risk")).alias("observed"))
    return n.join(F.broadcast(steps), "bucket", "left").select("bucket", "n", "predicted", F.coalesce("observed", F.lit(1.0)).alias("observed"))


def integrated_brier(subjects: DataFrame, survival: dict[int, float]) -> DataFrame:
    """Brier scores over a grid of horizons, by trapezoids and divided by the grid's span; one predicted survival a horizon."""
    grid = sorted(survival)
    if len(grid) < 2:
        raise ValueError("an integral needs two horizons")
    each = [brier_at(subjects, survival[t], t).withColumn("t", F.lit(t)) for t in grid]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    w = Window.partitionBy(F.lit(0)).orderBy("t")
    area = (F.col("t") - F.lag("t").over(w)) * (F.col("brier") + F.lag("brier").over(w)) / 2
    return every.select(area.alias("a")).agg((F.sum("a") / (grid[-1] - grid[0])).alias("integrated_brier"))
