"""Queries over graphs, plots, kernels and fitted models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import geometry as G
from granary.operators import fits, graph
from granary.operators import kernels as K
from granary.plans.joins import blocking_pairs
from granary.plans.registry import SQL, query
from granary.plans.scoring import rounded
from granary.plans.series import daily
from granary.sources.tables import scored_rows, table

PAIRS = SQL["blocking_pairs"]
EDGES = f"""WITH RECURSIVE e AS (SELECT left_id AS a, right_id AS b, 1.0 + (left_id + right_id) % 3 AS w, CASE (left_id + right_id) % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'device' ELSE 'name' END AS kind FROM ({PAIRS})),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON r.other = s.a), comp AS (SELECT node, min(other) AS community FROM reach GROUP BY 1)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("left_id") + F.col("right_id")) % 3
    return blocking_pairs(spark, sf).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), (1.0 + k).alias("w"), F.when(k == 0, "phone").when(k == 1, "device").otherwise("name").alias("kind"))


def communities(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    roots = graph.components(e.select("a", "b"))
    nodes = e.select(F.col("a").alias("n")).union(e.select("b")).distinct()
    return nodes.join(roots, nodes["n"] == roots["node"], "left").select(F.col("n").alias("node"), F.coalesce("root", "n").alias("community"))


@query(f"{EDGES} SELECT node, community FROM comp")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return communities(spark, sf)


@query(f"""{EDGES}, x AS (SELECT a.community AS ca, b.community AS cb, w FROM e JOIN comp a ON e.a = a.node JOIN comp b ON e.b = b.node),
s AS (SELECT c, sum(i) AS i, sum(w) AS t FROM (SELECT ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS i FROM x UNION ALL SELECT cb, w, CASE WHEN ca = cb THEN w ELSE 0 END FROM x) GROUP BY 1)
SELECT round(sum(i / (SELECT sum(t) FROM s) - power(t / (SELECT sum(t) FROM s), 2)), 6) AS modularity FROM s""")
def graph_modularity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.modularity(edges(spark, sf), communities(spark, sf)), "modularity")


@query(f"""{EDGES}, z AS (SELECT community, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT a.community, kind, count(*) AS n FROM e JOIN comp a ON e.a = a.node JOIN comp b ON e.b = b.node AND a.community = b.community GROUP BY ALL),
h AS (SELECT community, sum(n) AS edges, sum(-p * log2(p)) AS entropy FROM (SELECT community, n, n / CAST(sum(n) OVER (PARTITION BY community) AS DOUBLE) AS p FROM k) GROUP BY 1)
SELECT community, size, CAST(edges AS BIGINT) AS edges, round(edges / (size * (size - 1) / 2.0), 6) AS density, round(entropy, 6) AS entropy FROM z JOIN h USING (community)""")
def graph_community_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.community_scores(edges(spark, sf), communities(spark, sf)), "density", "entropy")


@query(f"{EDGES} SELECT a AS node, count(*) AS degree, sum(w) AS weight FROM (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e) GROUP BY 1")
def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.both_ways(edges(spark, sf)).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


@query()
def graph_louvain(spark: SparkSession, sf: str) -> DataFrame:
    return graph.louvain(edges(spark, sf))


_PLOTS = """WITH p AS (SELECT p_partkey AS id, [0.0, 100.0 + p_size, 120.0 + p_size, 10.0] AS xs, [0.0, 5.0, 90.0 + p_size, 80.0 + p_size * 2] AS ys FROM part),
v AS (SELECT id, xs[i] AS x1, ys[i] AS y1, xs[i % 4 + 1] AS x2, ys[i % 4 + 1] AS y2 FROM p, range(1, 5) t(i)),
s AS (SELECT id, sum(x1 * y2 - x2 * y1) / 2 AS a, sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))) AS per, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS cy FROM v GROUP BY 1)"""


def plots(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    corners = [(F.lit(0.0), F.lit(0.0)), (100 + s, F.lit(5.0)), (120 + s, 90 + s), (F.lit(10.0), 80 + s * 2)]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]).alias("p"))


@query(f"{_PLOTS} SELECT id, round(abs(a) / 10000, 6) AS hectares, round(per, 4) AS perimeter, round(4 * pi() * abs(a) / power(per, 2), 6) AS compactness, round(cx / (6 * a), 4) AS x, round(cy / (6 * a), 4) AS y, round((2.0 - abs(a) / 10000) / (abs(a) / 10000), 6) AS mismatch FROM s")
def plot_geometry(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    out = plots(spark, sf).select("id", G.area_hectares(p).alias("hectares"), G.perimeter(p).alias("perimeter"), G.compactness(p).alias("compactness"), G.centroid(p)["x"].alias("x"), G.centroid(p)["y"].alias("y"), G.area_mismatch(F.lit(2.0), p).alias("mismatch"))
    return rounded(rounded(out, "hectares", "compactness", "mismatch"), "perimeter", "x", "y", digits=4)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 5 + 0.1 AS nir, l_tax * 5 + 0.05 AS red, l_quantity / 100 AS blue FROM lineitem), z AS (SELECT *, (nir - red) / (nir + red) * 4 AS z FROM b)
SELECT l_orderkey, l_linenumber, round((nir - red) / (nir + red), 6) + 0.0 AS ndvi, round(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1), 4) + 0.0 AS evi, round(10 * log10(nir), 6) + 0.0 AS db,
CASE WHEN z >= 2 THEN 'extremely_wet' WHEN z >= 1.5 THEN 'severely_wet' WHEN z >= 1 THEN 'moderately_wet' WHEN z > -1 THEN 'near_normal' WHEN z > -1.5 THEN 'moderate_drought' WHEN z > -2 THEN 'severe_drought' ELSE 'extreme_drought' END AS category FROM z WHERE abs(nir + 6 * red - 7.5 * blue + 1) > 0.01""")
def vegetation_indices(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 5 + 0.1).alias("nir"), (F.col("l_tax") * 5 + 0.05).alias("red"), (F.col("l_quantity") / 100).alias("blue"))
    nir, red, blue = F.col("nir"), F.col("red"), F.col("blue")
    out = l.filter(F.abs(nir + 6 * red - 7.5 * blue + 1) > 0.01).select("l_orderkey", "l_linenumber", (F.round(G.ndvi(nir, red), 6) + 0.0).alias("ndvi"), (F.round(G.evi(nir, red, blue), 4) + 0.0).alias("evi"), (F.round(G.backscatter_db(nir), 6) + 0.0).alias("db"), G.drought_category((nir - red) / (nir + red) * 4).alias("category"))
    return out


_BITS = {"lon": 15, "lat": 15}
_CELL = {"lon": "least(floor((CAST(c_custkey % 360 - 180 AS DOUBLE) + 180) / 360 * 32768), 32767)", "lat": "least(floor((c_acctbal / 120 + 90) / 180 * 32768), 32767)"}


def _letter(i: int) -> str:
    """The i-th letter of a geohash of six: five bits, longitude first, in turns."""
    parts = []
    for k in range(5):
        n = 5 * i + k
        axis = "lon" if n % 2 == 0 else "lat"
        parts.append(f"((CAST({axis} AS BIGINT) >> {_BITS[axis] - 1 - n // 2}) & 1) * {1 << (4 - k)}")
    return f"substr('{G.BASE32}', CAST({' + '.join(parts)} + 1 AS INTEGER), 1)"


@query(f"WITH c AS (SELECT c_custkey, {_CELL['lon']} AS lon, {_CELL['lat']} AS lat FROM customer) SELECT c_custkey, {' || '.join(_letter(i) for i in range(6))} AS geohash FROM c")
def plot_geohash(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", G.geohash(F.col("c_acctbal") / 120, F.col("c_custkey").cast("double") % 360 - 180).alias("geohash"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n, sum(value) AS v FROM events GROUP BY ALL) SELECT round(regr_slope(v, n), 4) AS slope, round(regr_intercept(v, n), 3) AS intercept, round(regr_r2(v, n), 5) AS r2 FROM d""")
def macro_regression(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    beta, _, r2 = fits.least_squares(d, "v", ["n"])
    return spark.createDataFrame([(round(float(beta[1]), 4), round(float(beta[0]), 3), round(r2, 5))], "slope double, intercept double, r2 double")


@query()
def calibration_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(fits.isotonic_curve(scored_rows(spark, sf)), "score double, fitted double")


@query()
def calibration_platt(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([fits.platt_coefficients(scored_rows(spark, sf))], "slope double, intercept double")


@query()
def calibration_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(fits.calibration_bins(scored_rows(spark, sf)), "bin bigint, n bigint, predicted double, observed double")


def _per_series(df: DataFrame, f, schema: str) -> DataFrame:
    """A kernel over each series in order; a series has one value per day."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values("moment"))
        # Plain objects: slices of Arrow-backed strings may come in chunks, which Spark does not take.
        return pd.DataFrame({c: out[c].to_numpy() if out[c].dtype.kind in "fi" else pd.Series(out[c].to_list(), dtype=object) for c in out.columns})

    return df.groupBy("series").applyInPandas(run, schema)


@query()
def changepoint_bayesian(spark: SparkSession, sf: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        z = (x - x.mean()) / (x.std() or 1)
        return pd.DataFrame({"series": pdf["series"], "moment": pdf["moment"], "probability": K.change_probability(z)})

    return _per_series(daily(spark, sf), run, "series string, moment date, probability double")


@query()
def changepoint_adaptive_window(spark: SparkSession, sf: str) -> DataFrame:
    """Each series as it is, lifted from its middle on by half of its mean, since its days alone hold no change."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        return pdf.iloc[K.adwin((x + (np.arange(len(x)) >= len(x) // 2) * x.mean() / 2) / (2 * x.max()))][["series", "moment"]].reset_index(drop=True)

    return _per_series(daily(spark, sf), run, "series string, moment date")


@query()
def anomaly_seasonal(spark: SparkSession, sf: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[K.seasonal_anomalies(pdf["x"].to_numpy(float), 7)][["series", "moment", "x"]].reset_index(drop=True)

    return _per_series(daily(spark, sf), run, "series string, moment date, x double")


@query()
def drought_standardised_index(spark: SparkSession, sf: str) -> DataFrame:
    """Months of synthetic rainfall per district of nations, from the orders' amounts."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("series"), month.alias("moment")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = K.standardised_index(pdf["x"].to_numpy(float), 3, least=5)
        return pd.DataFrame({"series": pdf["series"], "moment": pdf["moment"], "spi": z})

    return _per_series(o, run, "series bigint, moment int, spi double")


@query()
def anomaly_isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_003 + F.col("l_partkey")).alias("id"), "l_quantity", "l_extendedprice", "l_discount")
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return fits.anomaly_scores(l, fits.isolation_forest(l, names), names, "id")


@query()
def model_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf).select("id", "score", "score2", "label")
    return fits.out_of_fold(rows, ["score", "score2"], "id")


@query()
def model_cox(spark: SparkSession, sf: str) -> DataFrame:
    """Cox regression of default on the balance's step, over all accounts counted by time, event and step."""
    from granary.operators.panel import survival_subjects
    from granary.sources.tables import account_months

    s = survival_subjects(account_months(spark, sf)).select("time", (F.col("cause") == 1).cast("int").alias("event"), F.least(F.floor(F.col("balance") / 1e7), F.lit(5)).alias("x"))
    # Months times two times six rows at most.
    g = s.groupBy("time", "event", "x").agg(F.count("*").alias("n")).toPandas()
    time = g["time"].to_numpy(float)
    beta, value = K.cox(np.full(len(g), -1.0), time, g["event"].to_numpy(int), g[["x"]].to_numpy(float), g["n"].to_numpy(float)) if g["event"].any() else (np.zeros(1), 0.0)
    return spark.createDataFrame([("balance", float(beta[0]), float(value))], "feature string, coefficient double, log_likelihood double")


@query(r"""WITH n AS (SELECT left_id, right_id, a.c_name || '/' || a.c_mktsegment AS x, b.c_mktsegment || '/' || b.c_name AS y FROM (""" + PAIRS + """) JOIN customer a ON a.c_custkey = left_id JOIN customer b ON b.c_custkey = right_id) SELECT left_id, right_id, round(jaro_similarity(x, y), 6) AS jaro FROM n""")
def entity_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("left_id"), F.concat_ws("/", "c_name", "c_mktsegment").alias("x"))
    b = c.select(F.col("c_custkey").alias("right_id"), F.concat_ws("/", "c_mktsegment", "c_name").alias("y"))
    pairs = blocking_pairs(spark, sf).join(a, "left_id").join(b, "right_id")

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([K.jaro(p, q) for p, q in zip(x, y, strict=True)])

    return pairs.select("left_id", "right_id", F.round(similarity("x", "y"), 6).alias("jaro"))
