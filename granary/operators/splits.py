"""Splits of rows into training, validation, test and calibration: by vintage, by snapshot, by keyed hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key and the seed alone, whatever the partitions: 8 hexadecimal digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(seed), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def sampled(rows: DataFrame, key: str, rate: float, seed: str = "sample") -> DataFrame:
    """All rows of a keyed share of the keys."""
    return rows.filter(share_of(F.col(key), seed) < rate)


def by_vintage(rows: DataFrame, vintage: Column, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """(vintage, n, part): whole vintages, by the midpoint of their share of all rows in order."""
    v = rows.groupBy(vintage.alias("vintage")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    mid = (F.sum("n").over(whole.orderBy("vintage").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2.0) / F.sum("n").over(whole)
    return v.select("vintage", "n", F.when(mid < train, "train").when(mid < train + validation, "validation").otherwise("test").alias("part"))


def carved(vintages: DataFrame, fraction: float = 0.15) -> DataFrame:
    """The newest training vintages, of at least ``fraction`` of its rows, become ``calibration``. Rows: vintage, n, part.

    The cut is moved down to the start of a vintage; a cut that leaves nothing
    to train on, or an empty calibration part, is an error.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    w = Window.partitionBy("part")
    before = F.coalesce(F.sum("n").over(w.orderBy("vintage").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = vintages.withColumn("before_", before).withColumn("all_", F.sum("n").over(w))
    wanted = F.floor(F.lit(fraction) * F.col("all_"))
    cut = F.col("all_") - wanted
    newest = (F.col("before_") + F.col("n")) > cut
    bad = F.when(wanted == 0, F.raise_error(F.lit("the calibration part would be empty"))).when(newest & (F.col("before_") == 0), F.raise_error(F.lit("nothing would be left to train on"))).cast("string")
    part = F.when(F.col("part") != "train", F.col("part")).otherwise(F.coalesce(bad, F.when(newest, "calibration").otherwise("train")))
    return x.select("vintage", "n", part.alias("part"))


def not_chronological(rows: DataFrame, vintage: str, decided: str) -> DataFrame:
    """Vintages that begin before the one before them has ended; must be empty."""
    v = rows.groupBy(vintage).agg(F.min(decided).alias("first"), F.max(decided).alias("last"))
    return v.withColumn("ended", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy(vintage))).filter(F.col("ended") > F.col("first")).select(vintage, "first", "ended")


def without_time(rows: DataFrame, key: str, unsafe: bool, seed: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Rows with ``part`` by a keyed hash: only for a source declared to have no usable time."""
    if not unsafe:
        raise ValueError("a source with a time axis is split by time")
    u = share_of(F.col(key), seed)
    return rows.withColumn("part", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def by_snapshot(rows: DataFrame, cutoff: Column, snapshot: str = "snapshot") -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff, and those after it; null snapshots are in neither."""
    return rows.filter(F.col(snapshot) <= cutoff), rows.filter(F.col(snapshot) > cutoff)


def by_account(rows: DataFrame, key: str, holdout: float, seed: str = "survival-split") -> DataFrame:
    """Rows with ``held_out``: all rows of an account are on one side."""
    return rows.withColumn("held_out", share_of(F.col(key), seed) < holdout)
