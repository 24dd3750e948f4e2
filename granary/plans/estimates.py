"""Queries over probes of models, reasons, incidence, water balances and iterative fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.credit import expit
from granary.operators import estimates as E
from granary.operators import panel as P
from granary.plans.portfolio import HAZ
from granary.plans.registry import query
from granary.plans.scoring import rounded
from granary.sources.tables import ACCOUNT_MONTHS_SQL as AM
from granary.sources.tables import account_months, table

INPUTS = ["l_quantity", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), F.when(n % 7 > 0, F.col("l_quantity")).alias("l_quantity"), "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_partkey")


def score(x: dict[str, Column]) -> Column:
    """A logistic score that turns back at a medium quantity."""
    q = x["l_quantity"] / 50
    return expit(2 * q - 2 * q * q + 10 * x["l_discount"] - 5 * x["l_tax"])


_LINES = "WITH l AS (SELECT CASE WHEN l_linenumber % 7 > 0 THEN l_quantity END AS q, l_discount AS d, l_tax AS t FROM lineitem)"
_SCORE = "1 / (1 + exp(-(2 * ({q}) / 50 - 2 * ({q}) / 50 * ({q}) / 50 + 10 * ({d}) - 5 * ({t}))))"
_PROBES = [("l_quantity", {"q": "q * {s}"}), ("l_discount", {"d": "d * {s}"}), ("l_tax", {"t": "t * {s}"})]
_PROBED = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {_SCORE.format(**({'q': 'q', 'd': 'd', 't': 't'} | {k: v.format(s=1.1) for k, v in m.items()}))} - {_SCORE.format(q='q', d='d', t='t')} AS u, {_SCORE.format(**({'q': 'q', 'd': 'd', 't': 't'} | {k: v.format(s=0.9) for k, v in m.items()}))} - {_SCORE.format(q='q', d='d', t='t')} AS v FROM l WHERE q IS NOT NULL"
    for n, m in _PROBES
)


@query(f"{_LINES}, p AS ({_PROBED}) SELECT feature, round((sum(abs(u)) + sum(abs(v))) / (2 * count(*)), 6) AS mean_shift, round(max(greatest(abs(u), abs(v))), 6) AS max_shift, count(*) FILTER (u * v > 0 AND abs(u) > 1e-12) AS flips FROM p GROUP BY 1")
def model_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.sensitivity(lines(spark, sf), score, INPUTS), "mean_shift", "max_shift")


GRID = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]


@query(f"""{_LINES}, s AS (SELECT row_number() OVER () AS i, d, t FROM l), g AS (SELECT unnest({GRID}) AS q), y AS (SELECT i, q, {_SCORE.format(q='q', d='d', t='t')} AS y FROM s, g), z AS (SELECT y - lag(y) OVER (PARTITION BY i ORDER BY q) AS gap FROM y)
SELECT (SELECT count(*) FROM l) AS rows, count(*) FILTER (gap < -1e-12) AS breaks, round(coalesce(min(CASE WHEN gap < -1e-12 THEN gap END), 0), 6) AS worst FROM z""")
def model_monotone_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.monotone_breaks(lines(spark, sf), score, INPUTS, "l_quantity", GRID), "worst")


@query("""WITH p AS (SELECT p_partkey, unnest([struct_pack(f := 'brand', s := 50 - p_partkey % 51), struct_pack(f := 'price', s := round(60 - p_retailprice / 40, 4)), struct_pack(f := 'size', s := 40 - p_size)]) AS r FROM part),
o AS (SELECT p_partkey, r.f AS feature, CAST(r.s AS DOUBLE) AS shortfall, row_number() OVER (PARTITION BY p_partkey ORDER BY r.s DESC, r.f) AS place FROM p) SELECT p_partkey, CAST(place AS INTEGER) AS place, feature, round(shortfall, 4) AS shortfall FROM o WHERE place <= 2 AND shortfall > 0""")
def scorecard_reasons(spark: SparkSession, sf: str) -> DataFrame:
    points = {"size": F.col("p_size").cast("double"), "brand": (F.col("p_partkey") % 51).cast("double"), "price": 60 - F.round(60 - F.col("p_retailprice") / 40, 4)}
    r = E.shortfalls(points, {"size": 40, "brand": 50, "price": 60}, 2)
    out = table(spark, sf, "part").select("p_partkey", F.posexplode(r).alias("i", "r"))
    return out.select("p_partkey", (F.col("i") + 1).alias("place"), "r.feature", F.round("r.shortfall", 4).alias("shortfall"))


@query(f"""{AM}, h AS (SELECT account_id, month_index, coalesce(CASE WHEN dpd IS NOT NULL THEN dpd / 256.0 END, 0) AS a, (account_id % 10) / 32.0 AS b FROM am),
n AS (SELECT account_id, month_index, a / greatest(a + b, 1.0) AS a, b / greatest(a + b, 1.0) AS b FROM h), s AS (SELECT *, coalesce(product(greatest(1 - a - b, 0)) OVER (PARTITION BY account_id ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS alive FROM n)
SELECT account_id, month_index, round(alive * greatest(1 - a - b, 0), 6) + 0.0 AS survival, round(sum(alive * a) OVER w, 6) AS cif1, round(sum(alive * b) OVER w, 6) AS cif2 FROM s WINDOW w AS (PARTITION BY account_id ORDER BY month_index ROWS UNBOUNDED PRECEDING)""")
def hazard_incidence(spark: SparkSession, sf: str) -> DataFrame:
    h = account_months(spark, sf).select("account_id", "month_index", (F.col("dpd") / 256).alias("a"), ((F.col("account_id") % 10) / 32).alias("b"))
    out = E.incidence(h, "account_id", "month_index", "a", "b").select("account_id", "month_index", "survival", "cif1", "cif2")
    return rounded(out, "survival", "cif1", "cif2").withColumn("survival", F.col("survival") + 0.0)


@query(f"""{HAZ}, x AS (SELECT months_on_book AS t, event, balance / 1e8 AS b, account_id % 7 AS k FROM haz), m AS (SELECT t, sum(exp(0.3 * b - 0.1 * k) * b) / sum(exp(0.3 * b - 0.1 * k)) AS mb, sum(exp(0.3 * b - 0.1 * k) * k) / sum(exp(0.3 * b - 0.1 * k)) AS mk FROM x GROUP BY 1),
r AS (SELECT t, b - mb AS rb, k - mk AS rk FROM x JOIN m USING (t) WHERE event = 1) SELECT 'b' AS feature, round(corr(t, rb), 5) AS trend FROM r UNION ALL SELECT 'k', round(corr(t, rk), 5) FROM r""")
def cox_schoenfeld_trend(spark: SparkSession, sf: str) -> DataFrame:
    x = P.hazard_rows(account_months(spark, sf)).select("months_on_book", "event", (F.col("balance") / 1e8).alias("b"), (F.col("account_id") % 7).cast("double").alias("k"))
    return rounded(E.schoenfeld_trend(x, {"b": 0.3, "k": -0.1}, "months_on_book", "event"), "trend", digits=5)


_BALANCE = """WITH v AS (SELECT o_custkey % 8 AS series, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS moment, round(sum(o_totalprice) / 100000, 4) AS x FROM orders GROUP BY ALL),
s AS (SELECT series, moment, moment % 12 AS mon, round(sum(x) OVER w, 4) AS a, row_number() OVER (PARTITION BY series ORDER BY moment) AS i FROM v WINDOW w AS (PARTITION BY series ORDER BY moment ROWS 2 PRECEDING)),
j AS (SELECT series, moment, mon, a, row_number() OVER (PARTITION BY series, mon ORDER BY a) AS j, count(*) OVER (PARTITION BY series, mon) AS n FROM s WHERE i >= 3),
w AS (SELECT series, mon, avg(a) AS w0, avg(a * (n - j) / (n - 1)) AS w1, avg(a * (n - j) * (n - j - 1) / ((n - 1) * (n - 2))) AS w2 FROM j WHERE n >= 4 GROUP BY ALL),
f AS (SELECT *, (2 * w1 - w0) / (6 * w1 - w0 - 6 * w2) AS shape FROM w), g AS (SELECT *, CASE WHEN shape > 1 THEN gamma(1 + 1 / shape) * gamma(1 - 1 / shape) END AS gg FROM f), k AS (SELECT *, (w0 - 2 * w1) * shape / gg AS scale, w0 - (w0 - 2 * w1) * shape AS loc FROM g)"""


@query(_BALANCE + " SELECT series, moment, a AS accumulated, round(CASE WHEN gg IS NULL THEN NULL WHEN a > loc THEN 1 / (1 + power(scale / (a - loc), shape)) ELSE 0 END, 5) + 0.0 AS probability FROM j JOIN k USING (series, mon)")
def drought_balance_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Months of a synthetic water balance, from the orders' amounts."""
    from granary.operators import series as S

    moment = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    v = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 8).alias("series"), moment.alias("moment")).agg(F.round(F.sum("o_totalprice") / 100000, 4).alias("x"))
    s = S.accumulated(v, 3).withColumn("accumulated", F.round("accumulated", 4)).withColumn("mon", F.col("moment") % 12)
    out = E.balance_probability(s.select("series", "moment", "mon", "accumulated"), "accumulated", ["series", "mon"], 4)
    return out.select("series", "moment", "accumulated", (F.round("probability", 5) + 0.0).alias("probability"))


@query()
def loss_beta_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Discounts as losses given default, explained by quantity and tax."""
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("loss"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_tax") * 10).alias("tax"))
    beta, phi = E.beta_regression(rows, "loss", ["quantity", "tax"])
    return spark.createDataFrame([(n, float(v)) for n, v in zip(["intercept", "quantity", "tax", "precision"], [*beta, phi], strict=True)], "term string, estimate double")


@query()
def model_temperature(spark: SparkSession, sf: str) -> DataFrame:
    """Over-confident class probabilities of the lines' flags, and the temperature that mends them."""
    n = F.col("l_orderkey") % 3
    kinds = ["A", "N", "R"]
    p = F.array(*[F.when(n == i, 0.98).otherwise(0.01) for i in range(3)])
    rows = table(spark, sf, "lineitem").select(p.alias("p"), F.array_position(F.array(*map(F.lit, kinds)), F.col("l_returnflag")).cast("int").alias("at")).select("p", (F.col("at") - 1).alias("label"))
    t = E.temperature(rows, "p", "label")
    return rows.groupBy().agg(F.lit(t).alias("temperature"), F.avg(F.array_max(E.scaled(F.col("p"), t))).alias("confidence"))


@query()
def scorecard_stepwise(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of evidence of the lines' columns, one of them of the wrong sign."""
    l = lines(spark, sf).filter("l_quantity is not null")
    x = l.select("label", F.col("l_quantity").alias("f0"), F.col("l_discount").alias("f1"), F.col("l_tax").alias("f2"), (F.col("l_partkey") % 17).cast("double").alias("f3"), (F.col("label") * 2.0 + F.col("l_partkey") % 3).alias("f4"), (F.col("l_partkey") % 13).cast("double").alias("f5"), (F.col("l_partkey") % 5).cast("double").alias("f6"))
    s = E.stepwise(x, ["f0", "f1", "f2", "f3", "f4", "f5", "f6"], 5, minimum=3, rounds=6)
    return spark.createDataFrame([(f, float(s.coefficients[f]), s.settled) for f in s.features if f in s.coefficients], "feature string, coefficient double, settled boolean")


@query()
def hazard_competing(spark: SparkSession, sf: str) -> DataFrame:
    """Two boosted hazards over person-periods, and the incidence they imply per account."""
    rows = P.hazard_rows(account_months(spark, sf)).select("account_id", "month_index", "months_on_book", (F.col("balance") / 1e6).alias("size"), F.when(F.col("event") == 1, 1).when(F.col("account_id") % 9 == 0, 2).otherwise(0).alias("cause"))
    h, _ = E.competing_hazards(rows, ["months_on_book", "size"], {"default": 1, "prepaid": 2}, trees=2, depth=2, bins=8)
    return E.incidence(h, "account_id", "month_index", "h_default", "h_prepaid").groupBy("months_on_book").agg(F.count("*").alias("n"), F.avg("cif1").alias("default"), F.avg("cif2").alias("prepaid"))
