"""Ranking, calibration, stability and fairness metrics over scored rows.

Scores are grouped first: every running sum goes over distinct scores, not
rows, and ties share their place. A score column with very many distinct
values should be rounded by the caller; the single ordered window then stays
within the number of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def whole():
    """All distinct scores."""
    return Window.partitionBy(F.lit(0))


def down():
    """Scores from the highest to this one."""
    return whole().orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)


def up():
    """Scores from the lowest to this one."""
    return whole().orderBy("score").rowsBetween(Window.unboundedPreceding, 0)


def by_score(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows, positives and negatives per distinct score."""
    return rows.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")).withColumn("neg", F.col("n") - F.col("pos"))


def auc(grouped: DataFrame) -> DataFrame:
    """n, positives, auc with mid-ranks, gini in points, and the largest gap of the two distributions."""
    before = F.sum("neg").over(up()) - F.col("neg")
    wins = F.col("pos") * (before + F.col("neg") / 2)
    gap = F.abs(F.sum("pos").over(up()) / F.sum("pos").over(whole()) - F.sum("neg").over(up()) / F.sum("neg").over(whole()))
    out = grouped.select("n", "pos", "neg", wins.alias("w"), gap.alias("gap")).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum("neg").alias("neg"), F.sum("w").alias("w"), F.max("gap").alias("ks"))
    area = F.col("w") / F.when(F.col("positives") * F.col("neg") > 0, F.col("positives") * F.col("neg"))
    return out.select("n", "positives", area.alias("auc"), ((2 * area - 1) * 100).alias("gini"), "ks")


def precision_recall(grouped: DataFrame) -> DataFrame:
    """Per threshold, downwards: precision and recall of all rows at or above it."""
    tp, n = F.sum("pos").over(down()), F.sum("n").over(down())
    return grouped.select("score", (tp / n).alias("precision"), (tp / F.sum("pos").over(whole())).alias("recall"))


def average_precision(grouped: DataFrame) -> DataFrame:
    tp, n = F.sum("pos").over(down()), F.sum("n").over(down())
    return grouped.select((F.col("pos") / F.sum("pos").over(whole()) * tp / n).alias("t")).agg(F.sum("t").alias("average_precision"))


def point_metrics(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Brier score and log loss."""
    p, y = F.col(score), F.col(label)
    c = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return rows.agg(F.avg(F.pow(p - y, F.lit(2))).alias("brier"), F.avg(-F.when(y == 1, F.log(c)).otherwise(F.log(1 - c))).alias("log_loss"))


def alert_rate(rows: DataFrame, rate: float, order: list[Column], label: str = "label") -> DataFrame:
    """Precision and recall of the best max(1, round(rate n)) rows in a total order.

    A top-k, by sort and limit on the cluster, not a window over the table.
    """
    n, positives = rows.agg(F.count("*"), F.sum(F.col(label).cast("bigint"))).first()
    k = max(1, round(rate * n))
    top = rows.orderBy(*order).limit(k)
    return top.agg(F.count("*").alias("alerts"), F.sum(F.col(label).cast("bigint")).alias("hits")).select("alerts", "hits", (F.col("hits") / F.col("alerts")).alias("precision"), (F.col("hits") / F.lit(positives or None)).alias("recall"))


def quantile_edges(rows: DataFrame, bins: int, score: str = "score") -> DataFrame:
    """(k, edge): the value at sorted place floor(k n / bins), k from 1, by counts of distinct values."""
    g = rows.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
    g = g.withColumn("upto", F.sum("n").over(up())).withColumn("all", F.sum("n").over(whole()))
    k = F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("k")
    ks = g.select("score", "n", "upto", "all", k)
    place = F.floor(F.col("k") * F.col("all") / bins)
    return ks.filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("n"))).select("k", F.col("score").alias("edge"))


def stability(reference: DataFrame, current: DataFrame, edges: DataFrame, score: str = "score", floor: float = 1e-6) -> DataFrame:
    """Population stability index over left-closed bins of the edges."""
    e = edges.select(F.array_sort(F.collect_set("edge")).alias("edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        # One row of a few edges.
        b = df.select(F.col(score).alias("s")).crossJoin(F.broadcast(e)).select(F.size(F.filter("edges", lambda x: x <= F.col("s"))).alias("bin"))
        return b.groupBy("bin").agg(F.count("*").alias("n")).select("bin", (F.col("n") / F.sum("n").over(whole())).alias(name))

    bins = e.select(F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    both = bins.join(shares(reference, "e"), "bin", "left").join(shares(current, "a"), "bin", "left")
    a, x = F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(floor))
    return both.agg(F.sum((a - x) * F.log(a / x)).alias("psi"))


def stability_verdict(psi: Column) -> Column:
    return F.when(psi > 0.25, "act").when(psi > 0.1, "alert").otherwise("pass")


def swap_sets(rows: DataFrame, champion: Column, challenger: Column, label: str = "label", segment: str = "segment") -> DataFrame:
    """Per segment: rows of the four cells of two approvals, bads swapped in and out, and the segment's share of swap-outs over its share of rows."""
    x = rows.select(F.col(segment).alias("segment"), champion.alias("a"), challenger.alias("b"), F.col(label).alias("y"))
    count = lambda c: F.count(F.when(c, 1))
    inn, out = ~F.col("a") & F.col("b"), F.col("a") & ~F.col("b")
    g = x.groupBy("segment").agg(
        F.count("*").alias("n"), count(F.col("a") & F.col("b")).alias("both"), count(inn).alias("swap_in"), count(out).alias("swap_out"), count(~F.col("a") & ~F.col("b")).alias("neither"),
        count(inn & (F.col("y") == 1)).alias("swap_in_bad"), count(out & (F.col("y") == 1)).alias("swap_out_bad"),
    )
    share = (F.col("swap_out") / F.sum("swap_out").over(whole())) / (F.col("n") / F.sum("n").over(whole()))
    return g.withColumn("concentration", share)


def group_rates(rows: DataFrame, group: str, predicted: Column, label: str = "label") -> DataFrame:
    """Per group (nulls left out): selection rate, true and false positive rates; selected means predicted 0, an approval."""
    x = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), (predicted == 0).alias("s"), (F.col(label) == 0).alias("good"))
    g = x.groupBy("g").agg(F.count("*").alias("n"), F.count(F.when(F.col("s"), 1)).alias("selected"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("s") & F.col("good"), 1)).alias("tp"), F.count(F.when(F.col("s") & ~F.col("good"), 1)).alias("fp"))
    bad = F.col("n") - F.col("good")
    return g.select("g", "n", (F.col("selected") / F.col("n")).alias("selection"), (F.col("tp") / F.when(F.col("good") > 0, F.col("good"))).alias("tpr"), (F.col("fp") / F.when(bad > 0, bad)).alias("fpr"))


def disparities(rates: DataFrame) -> DataFrame:
    """Demographic parity difference and ratio, equalised odds and equal opportunity differences."""
    gap = lambda c: F.max(c) - F.min(c)
    return rates.agg(gap("selection").alias("dp_difference"), (F.min("selection") / F.max("selection")).alias("dp_ratio"), F.greatest(gap("tpr"), gap("fpr")).alias("eo_difference"), gap("tpr").alias("opportunity_difference"))


def equal_slices(grouped_rows: DataFrame, slices: int, order: str = "score", tie: str = "id", label: str = "label") -> DataFrame:
    """Rate of the label in equal slices of sorted rows, the remainder in the last.

    Places come from counts per value of the order, then from places within a
    value, so no window holds more than the rows of one value.
    """
    values = grouped_rows.groupBy(F.col(order).alias("v")).agg(F.count("*").alias("n"))
    lower = whole().orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.select("v", (F.sum("n").over(lower) - F.col("n")).alias("before"), F.floor(F.sum("n").over(whole()) / slices).alias("size"))
    rows = grouped_rows.join(values, grouped_rows[order] == values["v"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("v").orderBy(tie)) - 1)
    return rows.groupBy(F.least(F.floor(F.col("place") / F.col("size")) + 1, F.lit(slices)).cast("int").alias("slice")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))


def uplift_curve(rows: DataFrame) -> DataFrame:
    """Per distinct score, downwards: treated and control so far, and incremental outcomes. Rows: score, treated, outcome."""
    g = rows.groupBy("score").agg(*[F.sum(F.when(F.col("treated") == t, v).otherwise(0)).alias(n) for t in (1, 0) for n, v in ((f"n{t}", F.lit(1)), (f"y{t}", F.col("outcome")))])
    s = {c: F.sum(c).over(down()) for c in ("n1", "y1", "n0", "y0")}
    return g.select("score", s["n1"].alias("treated"), s["n0"].alias("control"), (s["y1"] - s["y0"] * s["n1"] / F.when(s["n0"] > 0, s["n0"])).alias("incremental"))


def uplift_area(rows: DataFrame, id_: str = "id", chunk: int = 1 << 16) -> DataFrame:
    """Area between the uplift curve over single rows and its diagonal, per row; ties in the score go by id, then treated, then outcome.

    Rows: id, score, treated, outcome. Each score's rows are cut into chunks of
    ids, so that no ordered window holds more than ``chunk`` ids of a score; what
    came before a chunk is summed over chunks.
    """
    names = ("n1", "y1", "n0", "y0")
    part = F.floor(F.col(id_) / chunk)
    arms = {n: F.when(F.col("treated") == t, v).otherwise(0) for t in (1, 0) for n, v in ((f"n{t}", F.lit(1)), (f"y{t}", F.col("outcome")))}
    r = rows.select(id_, "score", part.alias("part"), *[arms[n].cast("double").alias(n) for n in names])
    before = whole().orderBy(F.desc("score"), "part").rowsBetween(Window.unboundedPreceding, -1)
    g = r.groupBy("score", "part").agg(*[F.sum(n).alias(n) for n in names])
    g = g.select("score", "part", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"b_{n}") for n in names])
    inside = Window.partitionBy("score", "part").orderBy(id_, "n1", "y1", "y0").rowsBetween(Window.unboundedPreceding, 0)
    c = r.join(g, ["score", "part"]).select(*[(F.col(f"b_{n}") + F.sum(n).over(inside)).alias(n) for n in names])
    c = c.select((F.col("y1") - F.when(F.col("n0") > 0, F.col("y0") * F.col("n1") / F.col("n0")).otherwise(0.0)).alias("inc"), (F.col("n1") + F.col("n0")).alias("k"))
    s = c.agg(F.count("*").alias("n"), F.sum("inc").alias("total"), F.max_by("inc", "k").alias("last"), F.min_by("inc", "k").alias("first"))
    area = F.col("total") - (F.col("first") + F.col("last")) / 2
    return s.select("n", F.when(F.col("n") >= 2, (area - F.col("last") * (F.col("n") - 1) / 2) / F.col("n")).alias("qini"))


def balance(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """Standardised mean difference of each covariate between the arms."""
    long = rows.select("treated", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])).alias("c")).select("treated", "c.*")
    arm = lambda f, t: f(F.when(F.col("treated") == t, F.col("x")))
    g = long.groupBy("covariate").agg(arm(F.avg, 1).alias("m1"), arm(F.avg, 0).alias("m0"), arm(F.var_samp, 1).alias("v1"), arm(F.var_samp, 0).alias("v0"))
    return g.select("covariate", ((F.col("m1") - F.col("m0")) / F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("smd"))


def doubly_robust(log: DataFrame) -> DataFrame:
    """Value and standard error of a target policy. Rows: taken, target, propensity, reward, q_target, q_taken."""
    gain = F.when(F.col("taken") == F.col("target"), (F.col("reward") - F.col("q_taken")) / F.col("propensity")).otherwise(0.0)
    v = F.col("q_target") + gain
    w = F.when(F.col("taken") == F.col("target"), 1 / F.col("propensity")).otherwise(0.0)
    return log.agg(F.avg(v).alias("value"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("se"), (F.pow(F.sum(w), F.lit(2)) / F.sum(w * w)).alias("ess"), F.count(F.when(F.col("propensity") <= 1e-3, 1)).alias("violations"))


def weight_of_evidence(rows: DataFrame, bin_: Column, label: str = "label") -> DataFrame:
    """Per bin (missing values are a bin): goods, bads, weight of evidence and its part of the information value."""
    g = rows.groupBy(F.coalesce(bin_.cast("string"), F.lit("missing")).alias("bin")).agg(F.sum((F.col(label) == 0).cast("long")).alias("goods"), F.sum((F.col(label) == 1).cast("long")).alias("bads"))
    gs, bs = F.col("goods") / F.sum("goods").over(whole()), F.col("bads") / F.sum("bads").over(whole())
    woe = F.when((gs > 0) & (bs > 0), F.log(gs / bs))
    return g.select("bin", "goods", "bads", woe.alias("woe"), (woe * (gs - bs)).alias("iv"))
