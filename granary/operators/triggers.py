"""Agricultural triggers, their scope, what follows from a season's stage, and idempotent registers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.config import Pending, Ratified, read

TRIGGER = "trigger string, scope string, subject string, observed date, days int, value double"


def non_sowing(plots: DataFrame, as_of: date, cutoff: date | Pending | Ratified) -> DataFrame:
    """One trigger per plot without observed sowing at or after the cutoff, which must have been set. Rows: plot, sowing_observed; unknown counts as not observed."""
    last = F.lit(read(cutoff)).cast("date")
    day = F.lit(as_of).cast("date")
    late = plots.filter(~F.coalesce("sowing_observed", F.lit(False)) & (day >= last))
    return late.select(F.lit("non_sowing").alias("trigger"), F.lit("individual").alias("scope"), F.col("plot").cast("string").alias("subject"), day.alias("observed"), F.datediff(day, last).alias("days"), F.lit(None).cast("double").alias("value"))


def district_drought(indices: DataFrame, threshold: float | Pending | Ratified, timescale: int = 3) -> DataFrame:
    """One trigger per district whose index of the stated timescale is at or below the threshold. Rows: district, observed, timescale, value.

    Another timescale measures another thing, so such a row fails the run.
    """
    right = F.when(F.col("timescale") == timescale, True).otherwise(F.raise_error(F.lit(f"the index must be over {timescale} months")))
    return indices.filter(right).filter(F.col("value") <= read(threshold)).select(
        F.lit("district_drought").alias("trigger"), F.lit("district").alias("scope"), F.col("district").cast("string").alias("subject"), F.col("observed").cast("date").alias("observed"), F.lit(None).cast("int").alias("days"), F.col("value").cast("double").alias("value")
    )


def routed(triggers: DataFrame, districts: DataFrame) -> DataFrame:
    """Triggers with ``suppressed``: an individual one whose district has a trigger of its own. Districts: subject, district.

    The affected districts are distinct before the join, so triggers are not multiplied.
    """
    affected = triggers.filter("scope = 'district'").select(F.col("subject").alias("district")).distinct().withColumn("hit", F.lit(True))
    own = districts.select(F.col("subject").cast("string").alias("subject"), F.col("district").cast("string").alias("district"))
    out = triggers.join(own.dropDuplicates(["subject"]), "subject", "left").join(affected, "district", "left")
    return out.withColumn("suppressed", (F.col("scope") == "individual") & F.coalesce("hit", F.lit(False))).drop("hit", "district").select(*triggers.columns, "suppressed")


def season_action(stage: Column, inputs: list[str], equipment: list[str]) -> Column:
    """struct(action, products): support instead of sales in a drought, inputs once sown, equipment after a good harvest, else nothing."""
    if not inputs or not equipment:
        raise ValueError("a stage that opens an offer needs products to offer")
    none = F.array().cast("array<string>")
    pick = lambda action, products: F.struct(F.lit(action).alias("action"), products.alias("products"))
    return F.when(stage == "drought_flagged", pick("suppress_marketing", none)).when(stage == "sowing_confirmed", pick("offer", F.array(*map(F.lit, inputs)))).when(stage == "good_harvest", pick("offer", F.array(*map(F.lit, equipment)))).otherwise(pick("none", none))


def lead_summary(defaults: DataFrame, least: int | Pending | Ratified) -> DataFrame:
    """Defaults flagged in time, late or never, and the median lead (midway between the two middle ones). Rows: defaulted, flagged.

    Leads are counted per day first; days are few.
    """
    d = defaults.select(F.datediff("defaulted", "flagged").alias("lead")).groupBy("lead").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    known = F.when(F.col("lead").isNotNull(), F.col("n")).otherwise(0)
    upto = F.sum(known).over(w.orderBy("lead").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("upto", upto).withColumn("all", F.sum(known).over(w))
    at = lambda place: F.max(F.when(F.col("lead").isNotNull() & (F.col("upto") >= place) & (F.col("upto") - F.col("n") < place), F.col("lead")))
    limit = read(least)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    half = (F.col("all") + 1) / 2
    return d.agg(n(F.lit(True)).alias("defaults"), n(F.col("lead") >= limit).alias("in_time"), n(F.col("lead") < limit).alias("late"), n(F.col("lead").isNull()).alias("never"), ((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("median_lead"))


def granularity(borrowers: DataFrame, plots: DataFrame, villages: DataFrame, key: str = "borrower") -> DataFrame:
    """plot, village or null (no location at all) for each borrower."""
    has = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(True))
    x = borrowers.join(has(plots, "p_"), key, "left").join(has(villages, "v_"), key, "left")
    return x.select(*borrowers.columns, F.when(F.col("p_"), "plot").when(F.col("v_"), "village").alias("granularity"))


def climate(history: DataFrame, seasons: int) -> DataFrame:
    """Over each series' last ``seasons`` index values: shares of drought and of excess rain, mean and worst; series with fewer have null. Rows: series, moment, z."""
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("moment")))
    g = history.filter("z is not null").withColumn("place_", place).filter(F.col("place_") <= seasons).groupBy("series").agg(
        F.count("*").alias("seasons"), F.avg((F.col("z") <= -1).cast("double")).alias("drought"), F.avg((F.col("z") >= 1).cast("double")).alias("excess_rain"), F.avg("z").alias("mean"), F.min("z").alias("worst")
    )
    full = F.col("seasons") == seasons
    return g.select("series", "seasons", *[F.when(full, F.col(c)).alias(c) for c in ("drought", "excess_rain", "mean", "worst")])


def registered(existing: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """The register with incoming documents added: the same content again changes nothing, other content under a known key fails the run.

    Both: key, content. Contents are compared by hash within each key, whose
    versions differ only if that is an error.
    """
    both = existing.select(key, "content").unionByName(incoming.select(key, "content")).withColumn("hash_", F.sha2(F.coalesce("content", F.lit("")), 256))
    g = both.groupBy(key).agg(F.min("hash_").alias("lo"), F.max("hash_").alias("hi"), F.any_value("content").alias("content"))
    clash = F.raise_error(F.concat(F.lit("registered with other content: "), F.col(key).cast("string")))
    return g.filter(F.when(F.col("lo") == F.col("hi"), True).otherwise(clash)).select(key, "content")
