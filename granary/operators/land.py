"""Plots, holdings and districts: matching of boundaries, income, yields, land quality and geographic gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import credit
from granary.functions.passages import overlap
from granary.operators import fits
from granary.operators.joins import nearest_rank_of


@F.pandas_udf(T.DoubleType())
def _iou(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series([overlap(list(zip(a, b, strict=True)), list(zip(c, d, strict=True))) for a, b, c, d in zip(ax, ay, bx, by, strict=True)], dtype=np.float64)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two polygons, arrays of struct(x, y); the second is convex."""
    axis = lambda p, n: F.transform(p, lambda v: v[n].cast("double"))
    return _iou(axis(a, "x"), axis(a, "y"), axis(b, "x"), axis(b, "y"))


def boxed(df: DataFrame, polygon: str, size: float) -> DataFrame:
    """Rows with ``box``, the bounds of their polygon, and ``at``, the square cells of a grid that the box touches."""
    axis = lambda n: F.transform(polygon, lambda v: v[n].cast("double"))
    bounds = F.struct(*[f(axis(n)).alias(f"{n}{i}") for n in "xy" for i, f in enumerate((F.array_min, F.array_max))])
    span = lambda n: F.sequence(F.floor(F.col(f"box.{n}0") / size), F.floor(F.col(f"box.{n}1") / size))
    at = F.flatten(F.transform(span("x"), lambda x: F.transform(span("y"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    return df.withColumn("box", bounds).withColumn("at", at)


def snapped(plots: DataFrame, parcels: DataFrame, least: float, cell: float) -> DataFrame:
    """Each plot with its best-overlapping parcel where that reaches ``least``, else with its own boundary.

    Plots: id, p. Parcels: parcel, q. Both meet by the grid cells that their
    boxes touch, so the work grows with neighbours, not with the product; of
    equal overlaps the smaller parcel id wins. ``cell`` should be near a
    parcel's width.
    """
    if not 0 < least <= 1:
        raise ValueError("the least overlap lies in (0, 1]")
    a = boxed(plots.select("id", "p"), "p", cell).select("id", "p", F.col("box").alias("a"), F.explode("at").alias("at")).select("id", "p", "a", "at.*")
    b = boxed(parcels.select("parcel", "q"), "q", cell).select("parcel", "q", F.col("box").alias("b"), F.explode("at").alias("at")).select("parcel", "q", "b", "at.*")
    # The planner's estimate knows nothing of the cells, so it would broadcast millions of rows.
    met = a.join(b.hint("merge"), ["cx", "cy"])
    # A pair counts in the first cell that both touch, and only if the boxes share more than an edge.
    first = [F.col(f"c{n}") == F.floor(F.greatest(f"a.{n}0", f"b.{n}0") / cell) for n in "xy"]
    share = [F.greatest(f"a.{n}0", f"b.{n}0") < F.least(f"a.{n}1", f"b.{n}1") for n in "xy"]
    pairs = met.filter(first[0] & first[1] & share[0] & share[1]).select("id", "parcel", "q", iou(F.col("p"), F.col("q")).alias("iou"))
    best = pairs.filter(F.col("iou") >= least).groupBy("id").agg(F.max_by(F.struct("parcel", "iou", "q"), F.struct("iou", -F.col("parcel"))).alias("b"))
    out = plots.join(best, "id", "left")
    return out.select("id", F.coalesce("b.q", "p").alias("boundary"), F.col("b.parcel").alias("parcel"), F.col("b.iou").alias("iou"), F.col("b").isNotNull().alias("snapped"))


def overlap_gate(pairs: DataFrame, gate: float = 0.75, sample: int = 100, digits: int = 6) -> DataFrame:
    """Median (midway between the two middle values), mean, quartile and tenth by nearest rank, and the share below the gate; passes only on ``sample`` pairs or more.

    Rows: iou. Overlaps are rounded to ``digits``, which bounds the distinct values that are ordered.
    """
    r = pairs.select(F.round("iou", digits).alias("iou")).filter(F.col("iou").isNotNull())
    at = nearest_rank_of(r, "iou", [0.1, 0.25, 0.5]).groupBy().agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "low"))])
    total = r.agg(F.count("*").alias("n"), F.avg("iou").alias("mean"), F.avg((F.col("iou") < gate).cast("double")).alias("below"))
    # The upper middle value is the lower one of the reversed order.
    high = nearest_rank_of(r.select((-F.col("iou")).alias("v")), "v", [0.5]).agg((-F.max("value")).alias("high"))
    one = total.crossJoin(F.broadcast(at)).crossJoin(F.broadcast(high))
    median = (F.col("low") + F.col("high")) / 2
    return one.select("n", median.alias("median"), "mean", "p25", "p10", "below", ((F.col("n") >= sample) & (median >= gate)).alias("passed"))


def holding_income(holdings: DataFrame, seasons: DataFrame, stressed: bool = False) -> DataFrame:
    """Income of each borrower's whole holding, null with the reason where it cannot be told.

    Holdings: borrower, plot (null: known by village only). Seasons: borrower,
    plot, season, hectares, yield_p50, yield_p25, price_p50, price_p25,
    cost_per_hectare. A plot without a season, or a season without a cost,
    refuses the holding: part of an income looks like an income.
    """
    level = "p25" if stressed else "p50"
    gross, cost = F.col("hectares") * F.col(f"yield_{level}") * F.col(f"price_{level}"), F.col("hectares") * F.col("cost_per_hectare")
    unknown = F.count(F.when(F.col("cost_per_hectare").isNull() | gross.isNull(), 1))
    by_plot = seasons.groupBy("borrower", "plot").agg(F.sum(gross).alias("gross"), F.sum(cost).alias("cost"), unknown.alias("unknown"), F.collect_set("season").alias("in"))
    h = holdings.distinct().join(by_plot, ["borrower", "plot"], "left").groupBy("borrower").agg(
        F.count("plot").alias("plots"), F.count(F.when(F.col("plot").isNotNull() & F.col("unknown").isNull(), 1)).alias("unvalued"), F.sum("unknown").alias("unknown"),
        F.sum("gross").alias("gross_revenue"), F.sum("cost").alias("input_costs"), F.size(F.array_distinct(F.flatten(F.collect_list("in")))).alias("seasons"),
    )
    refused = F.when(F.col("plots") == 0, "village_only").when(F.col("unvalued") > 0, "unvalued_plots").when(F.col("unknown") > 0, "cost_unknown")
    ok = lambda c: F.when(refused.isNull(), F.col(c)).alias(c)
    return h.select("borrower", "plots", "seasons", ok("gross_revenue"), ok("input_costs"), F.when(refused.isNull(), F.col("gross_revenue") - F.col("input_costs")).alias("income"), refused.alias("refused"))


def geographic_gap(units: DataFrame, least: int = 30) -> DataFrame:
    """The units with the highest and the lowest approval rate among those of at least ``least`` rows, one row; no row with fewer than two such units.

    Units: unit, n, approved, land_quality. Of equal rates the smaller name counts.
    """
    u = units.filter(F.col("n") >= least).withColumn("rate", F.col("approved") / F.col("n"))
    low, high = credit.wilson(F.col("approved"), F.col("n"))
    u = u.withColumn("low", low).withColumn("high", high)
    row = F.struct("unit", "n", "rate", "low", "high", "land_quality")
    g = u.agg(F.count("*").alias("units"), F.min_by(row, F.struct(-F.col("rate"), F.col("unit"))).alias("t"), F.min_by(row, F.struct(F.col("rate"), F.col("unit"))).alias("b")).filter("units >= 2")
    return g.select(
        "units", F.col("t.unit").alias("highest"), F.col("b.unit").alias("lowest"), (F.col("t.rate") - F.col("b.rate")).alias("difference"), (F.col("b.rate") / F.when(F.col("t.rate") > 0, F.col("t.rate"))).alias("ratio"),
        (F.col("t.land_quality") - F.col("b.land_quality")).alias("land_quality_gap"), ((F.col("b.high") >= F.col("t.low")) & (F.col("t.high") >= F.col("b.low"))).alias("intervals_overlap"),
    )


def quality_components(plots: DataFrame, inputs: list[str], zone: str = "zone") -> DataFrame:
    """Each input scaled to 0..1 between its zone's least and greatest value; null where a zone has no spread."""
    span = plots.groupBy(zone).agg(*[f(c).alias(f"{n}_{c}") for c in inputs for n, f in (("lo", F.min), ("hi", F.max))])
    wide = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    return plots.join(span, zone).select(*plots.columns, *[credit.clipped((F.col(c) - F.col(f"lo_{c}")) / F.when(wide(c) > 0, wide(c))).alias(f"{c}_scaled") for c in inputs])


def quality_index(weights: dict[str, tuple[float, int]]) -> Column:
    """Weighted mean of scaled inputs; a direction below zero counts the input's absence. Without weights there is no index."""
    total = sum(abs(w) for w, _ in weights.values())
    if not total:
        raise ValueError("land quality has no ratified weights")
    x = lambda c, d: F.col(f"{c}_scaled") if d > 0 else 1 - F.col(f"{c}_scaled")
    return sum([w * x(c, d) for c, (w, d) in weights.items()], F.lit(0.0)) / total


def yield_model(rows: DataFrame, target: str, factors: list[str], least: int = 30, digits: int = 2) -> tuple[np.ndarray, dict[float, float], float]:
    """Least squares, the residuals' quantiles by nearest rank, and R squared; refuses fewer than ``least`` rows.

    Residuals are rounded to ``digits``, which bounds the values that are ordered.
    """
    known = rows.dropna(subset=[target, *factors])
    if len(known.take(least)) < least:
        raise ValueError(f"a yield model needs {least} rows")
    beta, _, r2 = fits.least_squares(known, target, factors)
    at = sum([F.col(f) * float(b) for f, b in zip(factors, beta[1:], strict=True)], F.lit(float(beta[0])))
    q = nearest_rank_of(known.select(F.round(F.col(target) - at, digits).alias("r")), "r", [0.1, 0.25, 0.5]).collect()
    return beta, {r["q"]: r["value"] for r in q}, r2


def predicted(beta: np.ndarray, quantile: float, factors: list[str]) -> Column:
    """The model's value moved by a residual quantile, not below zero."""
    at = sum([F.col(f) * float(b) for f, b in zip(factors, beta[1:], strict=True)], F.lit(float(beta[0])))
    return F.greatest(at + float(quantile), F.lit(0.0))


def mid_rank(df: DataFrame, value: str, by: str) -> DataFrame:
    """Share of the group below a value plus half of those at it, from counts per distinct value."""
    g = df.groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = g.select(by, value, ((upto - F.col("n") / 2) / F.sum("n").over(Window.partitionBy(by))).alias("percentile"))
    return df.join(ranks, [by, value])


def tile_features(tiles: DataFrame, side: int, radii: tuple[int, ...] = (2, 6), id_: str = "tile") -> DataFrame:
    """Mean and standard deviation of the square of each radius around every pixel, edges repeated; one row per pixel.

    Rows: tile, pixels (array of side * side values, row by row). A tile is one
    value, so tiles are independent and need no shuffle; sums over squares come
    from one summed-area table a tile.
    """
    names = [f"{n}_{r}" for r in radii for n in ("mean", "std")]

    def box(a: np.ndarray, r: int) -> np.ndarray:
        t = np.pad(np.pad(a, r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        w = 2 * r + 1
        return (t[w:, w:] - t[:-w, w:] - t[w:, :-w] + t[:-w, :-w]) / w**2

    def run(batches):
        for pdf in batches:
            parts = []
            for key, px in zip(pdf["id"], pdf["pixels"], strict=True):
                a = np.asarray(px, float).reshape(side, side)
                cols = {"id": key, "pixel": np.arange(side * side), "value": a.ravel()}
                for r in radii:
                    m = box(a, r)
                    cols[f"mean_{r}"], cols[f"std_{r}"] = m.ravel(), np.sqrt(np.maximum(box(a * a, r) - m * m, 0)).ravel()
                parts.append(pd.DataFrame(cols))
            if parts:
                yield pd.concat(parts)

    whole = tiles.filter(F.size("pixels") == side * side).select(F.col(id_).alias("id"), F.transform("pixels", lambda x: x.cast("double")).alias("pixels"))
    kind = whole.schema["id"].dataType.simpleString()
    return whole.mapInPandas(run, f"id {kind}, pixel int, value double, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("id", id_)
