"""Queries over plots, holdings, districts and image tiles, and further survival and uplift measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.decisions import downscaled
from granary.operators import land as L
from granary.operators import metrics as M
from granary.operators import panel as P
from granary.operators import survival as S
from granary.plans.portfolio import SUBJECTS
from granary.plans.registry import query
from granary.plans.scoring import _ACTIONS, actions, rounded
from granary.sources.tables import account_months, table

_INCOME = """WITH hd AS (SELECT DISTINCT l_suppkey AS borrower, CASE WHEN l_suppkey % 10 > 0 THEN l_partkey END AS plot FROM lineitem),
sn AS (SELECT l_suppkey AS borrower, l_partkey AS plot, year(l_shipdate) AS season, l_quantity / 10 AS ha, 2 + l_discount * 10 AS y50, 1 + l_discount * 10 AS y25, l_tax * 100 + 20 AS p50, l_tax * 100 + 15 AS p25, CASE WHEN l_suppkey % 5 <> 2 OR l_linenumber > 1 THEN 30 + l_linenumber END AS c FROM lineitem WHERE l_suppkey % 4 <> 1 OR l_partkey % 5 > 0),
pl AS (SELECT borrower, plot, sum(ha * {y} * {p}) AS gross, sum(ha * c) AS cost, count(*) FILTER (c IS NULL) AS unknown FROM sn GROUP BY ALL),
h AS (SELECT borrower, count(hd.plot) AS plots, count(*) FILTER (hd.plot IS NOT NULL AND unknown IS NULL) AS unvalued, sum(unknown) AS unknown, sum(gross) AS gross, sum(cost) AS cost FROM hd LEFT JOIN pl USING (borrower, plot) GROUP BY 1),
ss AS (SELECT borrower, count(DISTINCT season) AS seasons FROM hd JOIN sn USING (borrower, plot) GROUP BY 1),
r AS (SELECT h.*, CAST(coalesce(seasons, 0) AS INTEGER) AS seasons, CASE WHEN plots = 0 THEN 'village_only' WHEN unvalued > 0 THEN 'unvalued_plots' WHEN unknown > 0 THEN 'cost_unknown' END AS refused FROM h LEFT JOIN ss USING (borrower))
SELECT borrower, plots, seasons, round(CASE WHEN refused IS NULL THEN gross END, 2) AS gross_revenue, round(CASE WHEN refused IS NULL THEN cost END, 2) AS input_costs, round(CASE WHEN refused IS NULL THEN gross - cost END, 2) AS income, refused FROM r"""


def incomes(spark: SparkSession, sf: str, stressed: bool) -> DataFrame:
    """Suppliers as borrowers and the parts they ship as plots."""
    l = table(spark, sf, "lineitem")
    b, d, t = F.col("l_suppkey"), F.col("l_discount"), F.col("l_tax")
    holdings = l.select(b.alias("borrower"), F.when(b % 10 > 0, F.col("l_partkey")).alias("plot"))
    seasons = l.filter((b % 4 != 1) | (F.col("l_partkey") % 5 > 0)).select(
        b.alias("borrower"), F.col("l_partkey").alias("plot"), F.year("l_shipdate").alias("season"), (F.col("l_quantity") / 10).alias("hectares"), (2 + d * 10).alias("yield_p50"), (1 + d * 10).alias("yield_p25"),
        (t * 100 + 20).alias("price_p50"), (t * 100 + 15).alias("price_p25"), F.when((b % 5 != 2) | (F.col("l_linenumber") > 1), 30.0 + F.col("l_linenumber")).alias("cost_per_hectare"),
    )
    return rounded(L.holding_income(holdings, seasons, stressed), "gross_revenue", "input_costs", "income", digits=2)


@query(_INCOME.format(y="y50", p="p50"))
def land_expected_income(spark: SparkSession, sf: str) -> DataFrame:
    return incomes(spark, sf, False)


@query(_INCOME.format(y="y25", p="p25"))
def land_stressed_income(spark: SparkSession, sf: str) -> DataFrame:
    return incomes(spark, sf, True)


_WILSON = "(approved / n + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(approved / n * (1 - approved / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"""WITH u AS (SELECT c_nationkey AS unit, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (c_acctbal > 2000) AS DOUBLE) AS approved, avg(c_acctbal) / 10000 AS q FROM customer GROUP BY 1 HAVING count(*) >= 5),
v AS (SELECT *, approved / n AS rate, {_WILSON.format(s='-')} AS low, {_WILSON.format(s='+')} AS high FROM u), t AS (SELECT * FROM v ORDER BY rate DESC, unit LIMIT 1), b AS (SELECT * FROM v ORDER BY rate, unit LIMIT 1)
SELECT (SELECT count(*) FROM v) AS units, t.unit AS highest, b.unit AS lowest, round(t.rate - b.rate, 6) AS difference, round(b.rate / t.rate, 6) AS ratio, round(t.q - b.q, 6) AS land_quality_gap, b.high >= t.low AND t.high >= b.low AS intervals_overlap FROM t, b""")
def land_geographic_gap(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.count("*").alias("n"), F.count(F.when(F.col("c_acctbal") > 2000, 1)).alias("approved"), (F.avg("c_acctbal") / 10000).alias("land_quality"))
    return rounded(L.geographic_gap(u, 5), "difference", "ratio", "land_quality_gap")


@query("""WITH z AS (SELECT p_brand, min(p_size) AS ls, max(p_size) AS hs, min(p_retailprice) AS lp, max(p_retailprice) AS hp FROM part GROUP BY 1),
s AS (SELECT p_partkey, (p_size - ls) / CAST(nullif(hs - ls, 0) AS DOUBLE) AS a, (p_retailprice - lp) / nullif(hp - lp, 0) AS b FROM part JOIN z USING (p_brand))
SELECT p_partkey, round(a, 6) AS p_size_scaled, round(b, 6) AS p_retailprice_scaled, round((0.6 * a + 0.4 * (1 - b)) / 1.0, 6) AS land_quality FROM s""")
def land_quality(spark: SparkSession, sf: str) -> DataFrame:
    p = L.quality_components(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_brand")
    out = p.withColumn("land_quality", L.quality_index({"p_size": (0.6, 1), "p_retailprice": (0.4, -1)}))
    return rounded(out.select("p_partkey", "p_size_scaled", "p_retailprice_scaled", "land_quality"), "p_size_scaled", "p_retailprice_scaled", "land_quality")


_YIELD = """WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y, l_quantity / 50 AS a, l_discount * 10 AS b FROM lineitem),
c AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM d),
e AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS b1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c), f AS (SELECT b1, b2, my - b1 * ma - b2 * mb AS b0 FROM e),
r AS (SELECT round(y - b0 - b1 * a - b2 * b, 2) AS r FROM d, f), o AS (SELECT r, row_number() OVER (ORDER BY r) AS i, count(*) OVER () AS n FROM r)
"""


@query(_YIELD + """SELECT q, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, (SELECT max(r) FROM o WHERE i = greatest(ceil(q * n), 1)) AS residual, round(greatest(b0 + b1 * 0.5 + b2 * 0.5 + (SELECT max(r) FROM o WHERE i = greatest(ceil(q * n), 1)), 0), 4) AS typical FROM f, (SELECT unnest([0.1, 0.25, 0.5]::DOUBLE[]) AS q)""")
def yield_model(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    beta, quantiles, _ = L.yield_model(d, "y", ["a", "b"])
    rows = [(float(q), *map(float, beta), float(v), 0.5, 0.5) for q, v in sorted(quantiles.items())]
    out = spark.createDataFrame(rows, "q double, b0 double, b1 double, b2 double, residual double, a double, b double")
    typical = F.greatest(F.col("b0") + F.col("b1") * F.col("a") + F.col("b2") * F.col("b") + F.col("residual"), F.lit(0.0))
    return rounded(out.select("q", "b0", "b1", "b2", "residual", typical.alias("typical")), "b0", "b1", "b2", "typical", digits=4)


@query("""WITH r AS (SELECT p_partkey, p_brand, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + count(*) OVER (PARTITION BY p_brand, p_size) / 2.0) / count(*) OVER (PARTITION BY p_brand) AS percentile FROM part)
SELECT p_partkey, round(percentile, 6) AS percentile, round(3.2 * (1 + 0.3 * (2 * percentile - 1)), 6) AS plot_yield FROM r""")
def yield_downscaled(spark: SparkSession, sf: str) -> DataFrame:
    p = L.mid_rank(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_size", "p_brand")
    return rounded(p.select("p_partkey", "percentile", downscaled(F.lit(3.2), F.col("percentile")).alias("plot_yield")), "percentile", "plot_yield")


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))


_SNAP = """WITH a AS (SELECT p_partkey AS id, p_partkey % 40 * 50 + p_size % 23 AS x0, p_partkey // 40 * 50 + p_partkey % 7 AS y0, 40 + p_size % 10 AS w, 45 AS h FROM part), b AS (SELECT p_partkey AS parcel, p_partkey % 40 * 50 AS u0, p_partkey // 40 * 50 AS v0 FROM part),
o AS (SELECT id, parcel, (least(x0 + w, u0 + 50) - greatest(x0, u0)) * (least(y0 + h, v0 + 50) - greatest(y0, v0)) AS s, w * h AS area FROM a JOIN b ON x0 < u0 + 50 AND u0 < x0 + w AND y0 < v0 + 50 AND v0 < y0 + h),
q AS (SELECT id, parcel, s / CAST(area + 2500 - s AS DOUBLE) AS iou FROM o)"""


def plots_and_parcels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as walked rectangles, each shifted against a parcel of a regular grid."""
    k, s, p = F.col("p_partkey"), F.col("p_size"), table(spark, sf, "part")
    row = F.floor(k / 40) * 50
    return p.select(k.alias("id"), rectangle(k % 40 * 50 + s % 23, row + k % 7, 40 + s % 10, F.lit(45)).alias("p")), p.select(k.alias("parcel"), rectangle(k % 40 * 50, row, F.lit(50), F.lit(50)).alias("q"))


@query(_SNAP + """, m AS (SELECT id, parcel, iou, row_number() OVER (PARTITION BY id ORDER BY iou DESC, parcel) AS i FROM q WHERE iou >= 0.5)
SELECT a.id, m.parcel, round(m.iou, 6) AS iou, m.id IS NOT NULL AS snapped FROM a LEFT JOIN m ON a.id = m.id AND m.i = 1""")
def plot_snapped(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.snapped(*plots_and_parcels(spark, sf), 0.5, 50.0).select("id", "parcel", "iou", "snapped"), "iou")


@query(_SNAP + """, g AS (SELECT round(iou, 6) AS v FROM q WHERE id = parcel), od AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM g)
SELECT count(*) AS n, round(median(v), 6) AS median, round(avg(v), 6) AS mean, max(v) FILTER (i = ceil(0.25 * n)) AS p25, max(v) FILTER (i = ceil(0.1 * n)) AS p10, round(avg(CASE WHEN v < 0.75 THEN 1.0 ELSE 0 END), 6) AS below, count(*) >= 100 AND median(v) >= 0.75 AS passed FROM od""")
def plot_overlap_gate(spark: SparkSession, sf: str) -> DataFrame:
    a, b = plots_and_parcels(spark, sf)
    pairs = a.join(b, F.col("id") == F.col("parcel")).select(L.iou(F.col("p"), F.col("q")).alias("iou"))
    return rounded(L.overlap_gate(pairs), "median", "mean", "below")


@query("""WITH e AS (SELECT vec_id AS tile, CAST(embedding[i + 1] AS DOUBLE) AS v, i FROM embeddings, range(64) t(i) WHERE len(embedding) = 64),
n AS (SELECT i, dy, dx, greatest(least(i // 8 + dy, 7), 0) * 8 + greatest(least(i % 8 + dx, 7), 0) AS j FROM range(64) t(i), range(-2, 3) a(dy), range(-2, 3) b(dx)),
w AS (SELECT e.tile, n.i AS pixel, avg(v) AS m2, stddev_pop(v) AS s2, avg(v) FILTER (abs(dy) < 2 AND abs(dx) < 2) AS m1, stddev_pop(v) FILTER (abs(dy) < 2 AND abs(dx) < 2) AS s1 FROM n JOIN e ON e.i = n.j GROUP BY ALL)
SELECT w.tile, CAST(pixel AS INTEGER) AS pixel, round(v, 5) AS value, round(m1, 5) AS mean_1, round(s1, 5) AS std_1, round(m2, 5) AS mean_2, round(s2, 5) AS std_2 FROM w JOIN e ON e.tile = w.tile AND e.i = w.pixel""")
def tile_features(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as tiles of 8 by 8 pixels."""
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile"), F.col("embedding").alias("pixels"))
    return rounded(L.tile_features(t, 8, (1, 2)), "value", "mean_1", "std_1", "mean_2", "std_2", digits=5)


@query(f"""{_ACTIONS}, c AS (SELECT row_number() OVER w AS k, sum(CASE WHEN treated = 1 THEN outcome ELSE 0 END) OVER w AS y1, sum(CASE WHEN treated = 0 THEN outcome ELSE 0 END) OVER w AS y0, sum(treated) OVER w AS n1, sum(1 - treated) OVER w AS n0 FROM act WINDOW w AS (ORDER BY score DESC, id, treated, outcome ROWS UNBOUNDED PRECEDING)),
d AS (SELECT k, y1 - CASE WHEN n0 > 0 THEN y0 * n1 / CAST(n0 AS DOUBLE) ELSE 0 END AS inc FROM c), s AS (SELECT count(*) AS n, sum(inc) AS total, arg_max(inc, k) AS last, arg_min(inc, k) AS first FROM d)
SELECT n, round((total - (first + last) / 2 - last * (n - 1) / 2) / n, 6) AS qini FROM s""")
def uplift_qini_area(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.uplift_area(actions(spark, sf), chunk=1 << 40), "qini")


_G = SUBJECTS + """, t0 AS (SELECT time, count(*) AS n, count(*) FILTER (cause = 0) AS d FROM subj GROUP BY 1),
r0 AS (SELECT time, d, sum(n) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM t0),
g AS (SELECT time AS tt, product(1 - d / CAST(at_risk AS DOUBLE)) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM r0 WHERE d > 0)"""


@query(_G + """, x AS (SELECT time, cause, balance // 10000000 AS risk, coalesce((SELECT arg_max(s, tt) FROM g WHERE tt < subj.time), 1.0) AS gb FROM subj), h AS (SELECT unnest([6, 12, 24]) AS t),
k AS (SELECT t, risk, sum(CASE WHEN cause = 1 AND time <= t AND gb > 0 THEN 1 / gb ELSE 0 END) AS w, count(*) FILTER (time > t) AS c FROM x, h GROUP BY ALL),
p AS (SELECT a.t, sum(a.w * b.c * CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) AS wins FROM k a JOIN k b USING (t) GROUP BY 1), z AS (SELECT t, sum(w) * sum(c) AS pairs FROM k GROUP BY 1)
SELECT t, round(CASE WHEN pairs > 0 THEN wins / pairs END, 6) AS auc FROM p JOIN z USING (t)""")
def survival_time_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.time_dependent_auc(P.survival_subjects(account_months(spark, sf)), F.floor(F.col("balance") / 10000000), [6, 12, 24]), "auc")


_BRIER = "avg(CASE WHEN time <= {t} AND cause = 1 THEN {s} * {s} / gb WHEN time > {t} THEN (1 - {s}) * (1 - {s}) / coalesce((SELECT arg_max(s, tt) FROM g WHERE tt <= {t}), 1.0) ELSE 0 END)"


@query(_G + ", x AS (SELECT time, cause, coalesce((SELECT arg_max(s, tt) FROM g WHERE tt < subj.time), 1.0) AS gb FROM subj), b AS (SELECT " + ", ".join(_BRIER.format(t=t, s=s) + f" AS b{t}" for t, s in ((6, 0.9), (12, 0.8), (24, 0.6))) + " FROM x) SELECT round((6 * (b6 + b12) / 2 + 12 * (b12 + b24) / 2) / 18, 6) AS integrated_brier FROM b")
def survival_integrated_brier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.integrated_brier(P.survival_subjects(account_months(spark, sf)), {6: 0.9, 12: 0.8, 24: 0.6}), "integrated_brier")


@query()
def survival_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions step with the balance, so buckets meet many ties."""
    return rounded(S.calibration_at(P.survival_subjects(account_months(spark, sf)), 1 / (1 + F.floor(F.col("balance") / 10000000) / 10), 12, 5), "predicted", "observed")
