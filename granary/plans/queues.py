"""Queries of fraud cases, alerts, splits, seasons, policies and further learners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import policy as P
from granary.operators import cases as C
from granary.operators import joins as J
from granary.operators import learners as L
from granary.operators import metrics as M
from granary.operators import panel
from granary.operators import seasons as S
from granary.operators import splits as T
from granary.plans.joins import ASOF, feature_history
from granary.plans.registry import query
from granary.plans.scoring import rounded
from granary.sources import ports
from granary.sources.tables import ACCOUNT_MONTHS_SQL as AM
from granary.sources.tables import SCORED_SQL as SC
from granary.sources.tables import account_months, scored_rows, table

TAXONOMY = {"F01": "confirmed", "F02": "cleared", "F03": "inconclusive"}
_CASES = """WITH cs AS (SELECT o_orderkey AS case_id, o_custkey AS application_id, o_orderpriority AS signal, o_orderdate AS opened FROM orders),
dp AS (SELECT l_orderkey AS case_id, ['F01', 'F02', 'F03', 'X'][l_linenumber % 4 + 1] AS code, CASE WHEN l_partkey % 9 > 0 THEN 'analyst' || l_partkey % 5 ELSE '' END AS analyst, l_shipdate AS done FROM lineitem WHERE l_orderkey % 3 > 0),
ds AS (SELECT *, code <> 'X' AND analyst <> '' AS sound FROM dp),
dg AS (SELECT case_id, min(struct_pack(done := done, code := code, analyst := analyst)) FILTER (sound) AS d, count(*) - count(*) FILTER (sound) + greatest(count(*) FILTER (sound) - 1, 0) AS refused FROM ds GROUP BY 1),
qu AS (SELECT cs.*, d.done AS closed, d.code AS code, CASE d.code WHEN 'F01' THEN 'confirmed' WHEN 'F02' THEN 'cleared' WHEN 'F03' THEN 'inconclusive' END AS outcome, coalesce(refused, 0) AS refused FROM cs LEFT JOIN dg USING (case_id))"""


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases; lines of two thirds of them as dispositions."""
    cs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("application_id"), F.col("o_orderpriority").alias("signal"), F.col("o_orderdate").alias("opened"))
    code = F.get(F.array(*map(F.lit, ("F01", "F02", "F03", "X"))), F.col("l_linenumber") % 4)
    analyst = F.when(F.col("l_partkey") % 9 > 0, F.concat(F.lit("analyst"), (F.col("l_partkey") % 5).cast("string"))).otherwise("")
    dp = table(spark, sf, "lineitem").filter("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("case_id"), code.alias("code"), analyst.alias("analyst"), F.col("l_shipdate").alias("at"))
    return C.closed(cs, dp, TAXONOMY)


@query(f"{_CASES} SELECT case_id, signal, closed, code, outcome, refused FROM qu")
def case_closings(spark: SparkSession, sf: str) -> DataFrame:
    return queue(spark, sf).select("case_id", "signal", "closed", "code", "outcome", "refused")


@query(f"{_CASES} SELECT signal, count(*) AS cases, count(outcome) AS closed, count(*) FILTER (outcome = 'confirmed') / CAST(count(outcome) AS DOUBLE) AS precision FROM qu GROUP BY 1")
def case_precision(spark: SparkSession, sf: str) -> DataFrame:
    return C.signal_precision(queue(spark, sf))


@query(f"{_CASES} SELECT count(*) AS cases, count(*) - count(outcome) AS open, count(outcome) / CAST(count(*) AS DOUBLE) AS completeness FROM qu")
def case_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return C.completeness(queue(spark, sf))


@query(f"{_CASES} SELECT application_id, CAST(outcome = 'confirmed' AS INTEGER) AS label FROM qu WHERE outcome IN ('confirmed', 'cleared')")
def case_labels(spark: SparkSession, sf: str) -> DataFrame:
    return C.training_labels(queue(spark, sf), True)


@query(f"{_CASES} SELECT case_id, CASE WHEN closed IS NULL THEN epoch(TIMESTAMP '1998-12-31') - epoch(opened) > 48 * 3600 ELSE epoch(closed) - epoch(opened) > 48 * 3600 END AS breached FROM qu")
def alert_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c: F.col(c).cast("timestamp")
    return queue(spark, sf).select("case_id", P.breached(at("opened"), at("closed"), F.lit("1998-12-31").cast("timestamp"), 48).alias("breached"))


@query("SELECT o_orderkey AS alert_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def alerts_undisposed(spark: SparkSession, sf: str) -> DataFrame:
    return C.undisposed(table(spark, sf, "orders").select(F.col("o_orderkey").alias("alert_id")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("alert_id")))


@query(f"""{SC}, g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY 1), c AS (SELECT pos / CAST(sum(pos) OVER () AS DOUBLE) * sum(pos) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS t FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
o AS (SELECT label, row_number() OVER (ORDER BY score DESC, id, label) AS i, greatest(1, CAST(round_even(0.005 * count(*) OVER (), 0) AS BIGINT)) AS k FROM scored), tp AS (SELECT avg(label) AS precision, sum(label) AS hits FROM o WHERE i <= k)
SELECT (SELECT count(*) FROM scored) AS n, (SELECT sum(label) FROM scored)::BIGINT AS frauds, round((SELECT sum(t) FROM c), 9) AS average_precision, round(precision, 9) AS precision, round(hits / (SELECT CAST(sum(label) AS DOUBLE) FROM scored), 9) AS recall, round((SELECT avg(CAST(id % 8 = 0 AS INTEGER)) FROM scored WHERE label = 0), 9) AS friction FROM tp""")
def fraud_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf).withColumn("stepped_up", (F.col("id") % 8 == 0).cast("int"))
    return rounded(C.fraud_evaluation(rows, 0.005, [F.desc("score"), F.asc("id"), F.asc("label")], stepped_up="stepped_up"), "average_precision", "precision", "recall", "friction", digits=9)


@query()
def calls_rate_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls of their user: at most 20 in a day."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("at"))
    return C.rate_limited(e, 20, 86400).select("event_id", "allowed")


@query("""WITH d AS (SELECT o_orderkey AS id, sha256('audit/' || o_orderkey) AS h, o_orderstatus AS outcome FROM orders), s AS (SELECT * FROM d ORDER BY h, id LIMIT 200) SELECT count(*) AS sampled, count(*) FILTER (CASE WHEN id % 11 = 0 THEN 'X' ELSE outcome END = outcome) AS matched, count(*) FILTER (CASE WHEN id % 11 = 0 THEN 'X' ELSE outcome END = outcome) / CAST(count(*) AS DOUBLE) AS match_rate FROM s""")
def decision_spot_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A replay that repeats all decisions but those of every eleventh order."""
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("outcome"))
    return C.spot_audit(d, lambda s: s.withColumn("outcome", F.when(F.col("id") % 11 == 0, "X").otherwise(F.col("outcome"))), 200)


_SHARE = "CAST('0x' || substr(sha256('{seed}/' || {key}), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"SELECT c_custkey FROM customer WHERE {_SHARE.format(seed='sample', key='c_custkey')} < 0.1")
def split_sampled_keys(spark: SparkSession, sf: str) -> DataFrame:
    return T.sampled(table(spark, sf, "customer"), "c_custkey", 0.1).select("c_custkey")


@query(f"SELECT c_custkey, CASE WHEN {_SHARE.format(seed='s7', key='c_custkey')} < 0.7 THEN 'train' WHEN {_SHARE.format(seed='s7', key='c_custkey')} < 0.85 THEN 'validation' ELSE 'test' END AS part FROM customer")
def split_without_time(spark: SparkSession, sf: str) -> DataFrame:
    return T.without_time(table(spark, sf, "customer").select("c_custkey"), "c_custkey", True, "s7")


@query(f"{AM} SELECT account_id, month_index, {_SHARE.format(seed='survival-split', key='account_id')} < 0.25 AS held_out FROM am")
def split_by_account(spark: SparkSession, sf: str) -> DataFrame:
    return T.by_account(account_months(spark, sf).select("account_id", "month_index"), "account_id", 0.25)


_PARTS = """WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') AS vintage, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT *, (sum(n) OVER (ORDER BY vintage) - n / 2.0) / sum(n) OVER () AS mid FROM v),
p AS (SELECT vintage, n, CASE WHEN mid < 0.7 THEN 'train' WHEN mid < 0.85 THEN 'validation' ELSE 'test' END AS part FROM m)"""


@query(f"""{_PARTS}, c AS (SELECT *, sum(n) OVER (PARTITION BY part ORDER BY vintage) AS upto, sum(n) OVER (PARTITION BY part) AS al FROM p)
SELECT vintage, n, CASE WHEN part = 'train' AND upto > al - floor(0.15 * al) THEN 'calibration' ELSE part END AS part FROM c""")
def split_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return T.carved(T.by_vintage(table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM")))


@query("""WITH v AS (SELECT year(o_orderdate) AS vintage, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER)) AS last FROM orders GROUP BY 1), l AS (SELECT vintage, first, lag(last) OVER (ORDER BY vintage) AS ended FROM v) SELECT vintage, first, ended FROM l WHERE ended > first""")
def split_not_chronological(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions up to two days after their order, so that some vintages overlap."""
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("vintage"), day.alias("day"), F.date_add(day, (F.col("o_orderkey") % 3).cast("int")).alias("later"))
    long = o.select("vintage", F.col("day").alias("decided")).unionByName(o.select("vintage", F.col("later").alias("decided")))
    return T.not_chronological(long, "vintage", "decided")


@query(f"{AM} SELECT snapshot <= DATE '1997-01-31' AS before, count(*) AS n FROM am GROUP BY 1")
def split_by_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    a, b = T.by_snapshot(account_months(spark, sf), F.lit("1997-01-31").cast("date"))
    count = lambda rows, side: rows.agg(F.count("*").alias("n")).select(F.lit(side).alias("before"), "n").filter("n > 0")
    return count(a, True).unionByName(count(b, False))


@query(ASOF.replace("event_time AS obs FROM ev WHERE event_type = 'signup'", "TIMESTAMP '2024-01-20' AS obs FROM ev") + " SELECT entity, obs, CASE WHEN status = 'found' THEN round(v, 6) END AS value, status FROM j")
def online_features(spark: SparkSession, sf: str) -> DataFrame:
    """What an online store would serve for every user at one moment."""
    from granary.plans.joins import TTL

    _, history = feature_history(spark, sf)
    users = table(spark, sf, "events").select(F.col("user_id").alias("entity")).distinct()
    return rounded(J.online(users, history, F.lit("2024-01-20").cast("timestamp"), TTL).withColumn("obs", F.col("obs").cast("timestamp_ntz")), "value")


_OBS = """WITH ob AS (SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS day, l_quantity AS value, l_linenumber > 1 AS ok, l_partkey % 12 AS scene_class FROM lineitem), mk AS (SELECT *, ok AND scene_class NOT IN (0, 1, 3, 8, 9, 10, 11) AS valid FROM ob)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    return S.masked(l.select(F.col("l_suppkey").alias("series"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("value"), (F.col("l_linenumber") > 1).alias("valid"), (F.col("l_partkey") % 12).alias("scene_class")))


@query(f"{_OBS} SELECT series, count(*) AS n, count(*) FILTER (valid) AS valid FROM mk GROUP BY 1")
def scenes_masked(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy("series").agg(F.count("*").alias("n"), F.count(F.when(F.col("valid"), 1)).alias("valid"))


@query(f"{_OBS} SELECT series, max(value) AS composite, count(*) AS observations FROM mk WHERE valid AND day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1")
def scene_composites(spark: SparkSession, sf: str) -> DataFrame:
    return S.composite(observations(spark, sf), F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))


@query("""WITH l AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT lag, row_number() OVER (ORDER BY lag) AS i, count(*) OVER () AS n FROM l), q AS (SELECT unnest([0.5, 0.9, 0.95]) AS q)
SELECT q, min(lag) AS lag FROM s, q WHERE i >= ceil(q * n) GROUP BY q""")
def publication_lags(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.lag_percentiles(j.select(F.col("o_orderdate").cast("date").alias("observed"), F.col("l_shipdate").cast("date").alias("ingested")), [0.5, 0.9, 0.95])


@query("SELECT o_orderkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') / 5.0) + 1 AS INTEGER) AS due FROM orders")
def ingests_expected(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", P.expected_ingests(F.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date"), 5).alias("due"))


@query("""WITH z AS (SELECT l_suppkey AS series, l_shipdate AS m, l_orderkey, l_linenumber, l_partkey, (l_quantity - 25) / 12 AS z FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY m DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, z DESC) AS i FROM z) SELECT series, avg(CAST(z <= -1 AS INTEGER)) AS frequency FROM r WHERE i <= 20 GROUP BY 1""")
def drought_frequency(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    z = (F.col("l_quantity") - 25) / 12
    return S.drought_frequency(l.select(F.col("l_suppkey").alias("series"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", z).alias("moment"), z.alias("z")), 20)


def _poly(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0])
    for a in c[1:]:
        out = f"(({out}) * {x} + {a!r})"
    return f"({out})"


_Z = f"""CASE WHEN p < {S.LOW} THEN {_poly(S.TAIL[0], "sqrt(-2 * ln(p))")} / {_poly(S.TAIL[1], "sqrt(-2 * ln(p))")} WHEN p > 1 - {S.LOW} THEN -{_poly(S.TAIL[0], "sqrt(-2 * ln(1 - p))")} / {_poly(S.TAIL[1], "sqrt(-2 * ln(1 - p))")}
 ELSE (p - 0.5) * {_poly(S.MIDDLE[0], "((p - 0.5) * (p - 0.5))")} / {_poly(S.MIDDLE[1], "((p - 0.5) * (p - 0.5))")} END"""


@query(f"""WITH v AS (SELECT p_partkey, least(greatest((p_partkey % 1000) / 999.0, 1e-10), 1 - 1e-10) AS p FROM part) SELECT p_partkey, round(least(greatest({_Z}, -3.09), 3.09), 9) AS z FROM v""")
def drought_normal_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(S.standardised((F.col("p_partkey") % 1000) / 999.0), 9).alias("z"))


@query(f"""{AM}, s AS (SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY month_index) - 1 AS place, CAST(balance AS DOUBLE) AS value FROM am), c AS (SELECT DISTINCT account_id, account_id % 12 AS "at" FROM am),
g AS (SELECT account_id, "at", avg(value) FILTER (place < "at") AS b, avg(value) FILTER (place >= "at") AS a FROM s JOIN c USING (account_id) GROUP BY ALL)
SELECT account_id AS series, "at", round(CASE WHEN a IS NOT NULL THEN b END, 4) AS mean_before, round(CASE WHEN b IS NOT NULL THEN a END, 4) AS mean_after FROM g""")
def change_described(spark: SparkSession, sf: str) -> DataFrame:
    am = account_months(spark, sf)
    s = am.select(F.col("account_id").alias("series"), (F.row_number().over(panel.account()) - 1).alias("place"), F.col("balance").cast("double").alias("value"))
    return rounded(S.described_change(s, am.select(F.col("account_id").alias("series"), (F.col("account_id") % 12).alias("at")).distinct()), "mean_before", "mean_after", digits=4)


@query(f"""{AM}, x AS (SELECT months_on_book AS t, balance / 1e8 AS b, account_id % 7 AS k, month_index, account_id, dpd, min(CASE WHEN dpd >= 90 THEN month_index END) OVER (PARTITION BY account_id) AS em FROM am), h AS (SELECT t, b, k, CAST(coalesce(month_index = em, false) AS INTEGER) AS event FROM x WHERE em IS NULL OR month_index <= em),
g AS (SELECT t, sum(event) AS events, sum(exp(0.3 * b - 0.1 * k)) AS total FROM h GROUP BY 1)
SELECT t AS time, CAST(events AS BIGINT) AS events, round(events / total, 9) AS hazard, round(sum(events / total) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 9) AS cumulative FROM g""")
def cox_baseline(spark: SparkSession, sf: str) -> DataFrame:
    h = panel.hazard_rows(account_months(spark, sf)).select("months_on_book", "event", (F.col("balance") / 1e8).alias("b"), (F.col("account_id") % 7).alias("k"))
    return rounded(L.baseline_hazard(h, {"b": 0.3, "k": -0.1}, "months_on_book", "event"), "hazard", "cumulative", digits=9)


SCENARIOS = {"baseline": {"growth": 0.02, "rate": 0.05}, "adverse": {"growth": -0.01, "rate": 0.08}}


@query("""WITH p AS (SELECT p_partkey, least(greatest((p_partkey % 97) / 100.0, 1e-6), 1 - 1e-6) AS r FROM part) SELECT p_partkey, round(1 / (1 + exp(-(ln(r / (1 - r)) + (-8 * -0.03 + 12 * 0.03)))), 9) AS stressed FROM p""")
def scenario_rates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(P.stressed((F.col("p_partkey") % 97) / 100.0, {"growth": -8.0, "rate": 12.0}, "adverse", SCENARIOS), 9).alias("stressed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((1 - l_discount) * l_tax, 9) AS lgd FROM lineitem")
def loss_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(P.two_stage_lgd(F.col("l_discount"), F.col("l_tax")), 9).alias("lgd"))


@query("""SELECT l_suppkey, CASE WHEN sum(l_tax) / count(*) * 10 < 0.02 THEN 'drop' WHEN sum(l_tax) / count(*) * 10 > 0.5 THEN 'investigate' ELSE 'pass' END AS verdict, CASE WHEN count(*) < 1000 OR count(*) FILTER (l_returnflag = 'R') < 100 THEN 'platt' ELSE 'isotonic' END AS calibrator FROM lineitem GROUP BY 1""")
def policy_screens(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.sum("l_tax") / F.count("*") * 10).alias("iv"), F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("pos"))
    return g.select("l_suppkey", P.screen_iv(F.col("iv")).alias("verdict"), P.calibrator(F.col("n"), F.col("pos")).alias("calibrator"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE) AS end_, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE last_day(CAST(o_orderdate AS DATE)) END AS observed FROM orders""")
def outcome_windows(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    w = P.outcome_window(day)
    kind = F.when(F.col("o_orderkey") % 2 == 0, "application").otherwise("behavioural")
    return table(spark, sf, "orders").select("o_orderkey", w["start"].alias("start"), w["end"].alias("end_"), P.observation_point(kind, day, F.last_day(day)).alias("observed"))


@query(f"""{SC}, g AS (SELECT score, count(*) FILTER (label = 0) AS neg, sum(label) AS pos FROM scored GROUP BY 1), c AS (SELECT sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE) AS fpr, sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr, row_number() OVER w AS place, count(*) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM c WHERE place % greatest(1, (n + 1) // 10) = 0 OR place = n UNION ALL SELECT 0, 0""")
def metric_roc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.roc(M.by_score(scored_rows(spark, sf)), 10), "fpr", "tpr", digits=9)


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN ['b'] WHEN 2 THEN ['a', 'c'] ELSE [] END AS arms, CAST('0x' || substr(sha256('explore/' || o_orderkey), 1, 8) AS BIGINT) AS h FROM orders)
SELECT o_orderkey, CASE WHEN len(arms) > 0 THEN arms[h % len(arms) + 1] END AS arm, CASE WHEN len(arms) > 0 THEN 1 / CAST(len(arms) AS DOUBLE) END AS propensity FROM d""")
def bandit_explored(spark: SparkSession, sf: str) -> DataFrame:
    lists = [["a", "b", "c"], ["b"], ["a", "c"], []]
    arms = F.get(F.array(*[F.array(*map(F.lit, c)).cast("array<string>") for c in lists]), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", L.explored(F.col("o_orderkey"), arms).alias("x")).select("o_orderkey", "x.arm", "x.propensity")


@query(f"""{SC}, a AS (SELECT score FROM scored WHERE segment = 'F'), b AS (SELECT score FROM scored WHERE segment <> 'F'), s AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM a), e AS (SELECT DISTINCT score AS edge FROM s, range(1, 10) t(k) WHERE i = k * n // 10),
bn AS (SELECT 'e' AS w, (SELECT count(*) FROM e WHERE edge <= a.score) AS bin, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'a', (SELECT count(*) FROM e WHERE edge <= b.score), count(*) FROM b GROUP BY ALL),
sh AS (SELECT bin, greatest(coalesce(max(n) FILTER (w = 'e'), 0) / (SELECT CAST(count(*) AS DOUBLE) FROM a), 1e-6) AS x, greatest(coalesce(max(n) FILTER (w = 'a'), 0) / (SELECT CAST(count(*) AS DOUBLE) FROM b), 1e-6) AS y FROM bn GROUP BY 1)
SELECT round(sum((y - x) * ln(y / x)), 9) AS psi, round((SELECT avg(score) FROM a), 9) AS accepted_mean, round((SELECT avg(score) FROM b), 9) AS rejected_mean FROM sh""")
def selection_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    return rounded(L.selection_gap(rows.filter("segment = 'F'"), rows.filter("segment <> 'F'")), "psi", "accepted_mean", "rejected_mean", digits=9)


@query()
def model_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    return L.validation_report(rows.filter("day < '1996-01-01'"), rows.filter("day >= '1996-01-01'"), {"auc": ("at_least", 0.6), "psi": ("at_most", 0.25)})


FEATURES = ["score", "score2"]


@query()
def model_random_forest(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    return L.class_probabilities(L.random_forest(rows, "label", FEATURES, trees=10, depth=4), rows, FEATURES, "id").select("id", "predicted", F.element_at("probabilities", 2).alias("probability"))


@query()
def model_fraud(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    model = L.fraud_model(rows, "label", FEATURES, {"score": 1}, trees=3)
    return rows.select("id", *model.binned()).select("id", model.probability().alias("probability"))


@query()
def model_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """Log loss of every setting on the later rows."""
    rows = scored_rows(spark, sf)
    _, best, tried = L.tuned(rows.filter("day < '1996-01-01'"), rows.filter("day >= '1996-01-01'"), "label", FEATURES, [{"trees": 2, "depth": 1}, {"trees": 2, "depth": 2}])
    return spark.createDataFrame([(str(s), float(loss), s == best) for s, loss in tried], "setting string, log_loss double, best boolean")


@query()
def model_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    from granary.operators import boosting

    return L.importance(boosting.fit(rows, "label", FEATURES, trees=3, depth=2), rows)


@query()
def model_out_of_fold_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_rows(spark, sf)
    return L.grouped_out_of_fold(rows, FEATURES, "id", F.quarter("day"), trees=2, depth=2)


@query("SELECT c_custkey AS c_custkey, c_acctbal, 0 AS missing, c_nationkey FROM customer")
def design_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return ports.aligned(table(spark, sf, "customer"), ["c_custkey", "c_acctbal", "missing", "c_nationkey"])


@query("SELECT l_partkey AS cell, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS total FROM lineitem GROUP BY ALL")
def weather_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return ports.monthly_weather(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cell"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("amount")))


@query("""WITH b AS (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice AS x FROM orders) SELECT k, max(v) AS v, arg_max(x, v) AS x FROM b GROUP BY 1""")
def store_latest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("x"))
    return ports.latest(o.filter("v % 2 = 0"), o.filter("v % 2 = 1"), "k", "v")


@query("SELECT 'label' AS measure, coalesce(o_orderstatus, 'censored') AS value, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 2 UNION ALL SELECT 'rows', 'all', count(*) FROM orders")
def source_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ports.profile(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("label")))
