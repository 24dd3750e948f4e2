"""Join queries: features as of a point in time, identity, ledger, alerts, velocity, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import credit
from granary.operators import joins as J
from granary.plans.registry import query
from granary.sources.tables import ACCOUNT_MONTHS_SQL as AM
from granary.sources.tables import TWO_CLOCK_SQL as EV
from granary.sources.tables import account_months, table, two_clock_events

TTL = 3 * 86400
ASOF = f"""{EV}, h AS (SELECT key AS entity, event_time AS event_ts, ingest_time AS created_ts, value FROM ev WHERE event_type = 'purchase'),
o AS (SELECT DISTINCT key AS entity, event_time AS obs FROM ev WHERE event_type = 'signup'),
b AS (SELECT o.entity, o.obs, arg_max(struct_pack(v := h.value, t := h.event_ts), struct_pack(a := h.event_ts, b := h.created_ts, c := h.value)) FILTER (h.event_ts IS NOT NULL) AS w
  FROM o LEFT JOIN h ON o.entity = h.entity AND h.event_ts <= o.obs AND h.created_ts <= o.obs GROUP BY ALL),
j AS (SELECT entity, obs, w.v AS v, CASE WHEN w.t IS NULL THEN 'missing' WHEN floor(epoch(obs)) - floor(epoch(w.t)) > {TTL} THEN 'expired' ELSE 'found' END AS status FROM b)"""


def feature_history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = two_clock_events(spark, sf)
    history = ev.filter("event_type = 'purchase'").select(F.col("key").alias("entity"), F.col("event_time").alias("event_ts"), F.col("ingest_time").alias("created_ts"), "value")
    return ev.filter("event_type = 'signup'").select(F.col("key").alias("entity"), F.col("event_time").alias("obs")).distinct(), history


@query(f"{ASOF} SELECT entity, obs, CASE WHEN status = 'found' THEN round(v, 6) END AS value, status FROM j")
def asof_features(spark: SparkSession, sf: str) -> DataFrame:
    obs, history = feature_history(spark, sf)
    return J.as_of(obs, history, TTL).withColumn("value", F.round("value", 6)).withColumn("obs", F.col("obs").cast("timestamp_ntz"))


@query(f"{ASOF} SELECT count(*) AS n, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'expired') AS expired, round(1 - count(*) FILTER (status = 'missing') / CAST(count(*) AS DOUBLE), 6) AS coverage FROM j")
def asof_coverage(spark: SparkSession, sf: str) -> DataFrame:
    obs, history = feature_history(spark, sf)
    return J.coverage(J.as_of(obs, history, TTL)).withColumn("coverage", F.round("coverage", 6))


@query(f"""{ASOF}, b2 AS (SELECT o.entity, o.obs, arg_max(h.value, struct_pack(a := h.event_ts, b := h.created_ts, c := h.value)) AS v FROM o LEFT JOIN h ON o.entity = h.entity AND h.event_ts <= o.obs GROUP BY ALL)
SELECT count(*) AS compared, count(*) FILTER (b2.v IS DISTINCT FROM b.w.v) AS skewed, CAST(0 AS BIGINT) AS missing_online FROM b2 JOIN b USING (entity, obs)""")
def asof_skew(spark: SparkSession, sf: str) -> DataFrame:
    """What a join that ignores the second clock gets wrong."""
    obs, history = feature_history(spark, sf)
    offline = J.as_of(obs, history.withColumn("created_ts", F.col("event_ts")))
    return J.skew(offline, J.as_of(obs, history), ["entity", "obs"])


KEY = """CASE WHEN {k} % 97 = 0 THEN 'n/a' WHEN {k} % 89 = 0 THEN 'A ' || {k} || '!' WHEN {k} % 83 = 0 THEN ' 7 ' ELSE '  ord-' || {k} || ' ' END"""
NORM = """SELECT *, CASE WHEN t = '' THEN 'null_key' WHEN t IN ('0','-','NA','N/A','NULL','NONE','UNKNOWN','NOT AVAILABLE','XXX') THEN 'placeholder_key' WHEN NOT regexp_matches(t, '^[A-Z0-9][A-Z0-9_-]*$') THEN 'charset_key' WHEN length(t) < 3 THEN 'too_short_key' END AS problem
 FROM (SELECT *, trim(upper(regexp_replace(trim(raw), '\\s+', ' ', 'g'))) AS t FROM {s})"""
SPINE = f"""WITH l0 AS (SELECT {KEY.format(k='o_orderkey')} AS raw, o_custkey AS customer FROM orders WHERE o_orderstatus <> 'P'),
a0 AS (SELECT {KEY.format(k='o_orderkey')} AS raw, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS applicant FROM orders WHERE o_orderkey % 10 <> 3),
c0 AS (SELECT DISTINCT {KEY.format(k='(l_orderkey + l_linenumber - 1)')} AS raw, l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
l AS ({NORM.format(s='l0')}), a AS (SELECT t AS key, min(applicant) AS applicant FROM ({NORM.format(s='a0')}) WHERE problem IS NULL GROUP BY 1), c AS (SELECT t AS ckey, count(*) AS cases FROM ({NORM.format(s='c0')}) WHERE problem IS NULL GROUP BY 1),
j AS (SELECT CASE WHEN problem IS NULL THEN t END AS key, customer, applicant, coalesce(cases, 0) AS cases, CASE WHEN problem IS NOT NULL THEN problem WHEN a.key IS NULL THEN 'no_application' WHEN customer <> applicant THEN 'customer_differs' END AS cause
  FROM l LEFT JOIN a ON problem IS NULL AND t = a.key LEFT JOIN c ON problem IS NULL AND t = ckey)"""


def raw_key(k):
    return F.when(k % 97 == 0, "n/a").when(k % 89 == 0, F.concat(F.lit("A "), k.cast("string"), F.lit("!"))).when(k % 83 == 0, " 7 ").otherwise(F.concat(F.lit("  ord-"), k.cast("string"), F.lit(" ")))


def identity_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    loans = o.select(raw_key(k).alias("loan_key"), F.col("o_custkey").alias("customer"), (F.col("o_orderstatus") != "P").alias("active"))
    apps = o.filter(k % 10 != 3).select(raw_key(k).alias("loan_key"), (F.col("o_custkey") + F.when(k % 50 == 0, 1).otherwise(0)).alias("customer"))
    cases = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(raw_key(F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("loan_key"), "l_orderkey").distinct()
    return loans, apps, cases


@query(f"{SPINE} SELECT * FROM j")
def identity_spine(spark: SparkSession, sf: str) -> DataFrame:
    return J.spine(*identity_sources(spark, sf))


@query(f"{SPINE} SELECT coalesce(cause, 'joined') AS cause, count(*) AS n FROM j GROUP BY 1")
def identity_spine_causes(spark: SparkSession, sf: str) -> DataFrame:
    return J.spine(*identity_sources(spark, sf)).groupBy(F.coalesce("cause", F.lit("joined")).alias("cause")).agg(F.count("*").alias("n"))


@query(f"{SPINE}, al AS (SELECT t AS lkey FROM (SELECT *, row_number() OVER () AS r FROM ({NORM.format(s='(SELECT ' + KEY.format(k='o_orderkey') + ' AS raw FROM orders)')})) WHERE problem IS NULL), cc AS ({NORM.format(s='c0')}) SELECT count(*) AS orphans FROM cc WHERE problem IS NOT NULL OR t NOT IN (SELECT lkey FROM al)")
def identity_orphans(spark: SparkSession, sf: str) -> DataFrame:
    loans, _, cases = identity_sources(spark, sf)
    return J.orphans(cases, loans).agg(F.count("*").alias("orphans"))


@query("""WITH b AS (SELECT o_orderpriority AS product, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS amount FROM orders),
m AS (SELECT DISTINCT product, 'GL-' || substr(product, 1, 1) AS account FROM b WHERE product NOT LIKE '5%'),
g AS (SELECT 'GL-' || substr(product, 1, 1) AS account, CAST(sum(amount) AS BIGINT) + CASE WHEN substr(product, 1, 1) = '2' THEN CAST(sum(amount) AS BIGINT) // 100 ELSE 7 END AS amount FROM b WHERE product NOT LIKE '5%' AND product NOT LIKE '4%' GROUP BY product UNION ALL SELECT 'GL-9', 12345),
p AS (SELECT account, sum(amount) AS platform FROM b LEFT JOIN m USING (product) GROUP BY 1),
j AS (SELECT coalesce(p.account, g.account) AS account, CAST(coalesce(platform, 0) AS BIGINT) AS platform, CAST(coalesce(amount, 0) AS BIGINT) AS gl FROM p FULL JOIN g ON p.account = g.account)
SELECT *, platform - gl AS delta, CASE WHEN account IS NULL THEN false WHEN gl = 0 THEN platform = 0 ELSE abs(platform - gl) / CAST(abs(gl) AS DOUBLE) <= 0.001 END AS within FROM j""")
def ledger_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("product"), credit.minor_units(F.col("o_totalprice")).alias("amount"))
    account = F.concat(F.lit("GL-"), F.substring("product", 1, 1))
    mapping = b.filter("product not like '5%'").select("product", account.alias("account")).distinct()
    total = F.sum("amount")
    ledger = b.filter("product not like '5%' and product not like '4%'").groupBy("product").agg(total.alias("t")).select(account.alias("account"), (F.col("t") + F.when(F.col("product").like("2%"), F.expr("t div 100")).otherwise(7)).alias("amount"))
    extra = spark.range(1).select(F.lit("GL-9").alias("account"), F.lit(12345).cast("bigint").alias("amount"))
    return J.reconcile(b, ledger.unionByName(extra), mapping)


@query("""WITH r AS (SELECT c_custkey AS id, '0:' || c_nationkey || '/' || CAST(floor(c_acctbal / 20) AS BIGINT) AS k1, CASE WHEN c_custkey % 3 = 0 THEN '1:' || CAST(floor(c_acctbal / 5) AS BIGINT) END AS k2 FROM customer),
b AS (SELECT id, k1 AS key FROM r UNION SELECT id, k2 FROM r WHERE k2 IS NOT NULL) SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM b a JOIN b ON a.key = b.key AND a.id < b.id""")
def blocking_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    by = lambda w: F.floor(F.col("c_acctbal") / w).cast("string")
    return J.candidate_pairs(c, [F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), by(20)), F.when(F.col("id") % 3 == 0, by(5))])


ALERTS = f"""{AM}, al AS (SELECT account_id, snapshot AS raised, CASE WHEN dpd >= 60 THEN 'RED' ELSE 'AMBER' END AS tier FROM am WHERE dpd BETWEEN 30 AND 89),
df AS (SELECT account_id, min(snapshot) AS defaulted FROM am WHERE dpd >= 90 GROUP BY 1),
cp AS (SELECT df.account_id, defaulted, max(date_diff('day', raised, defaulted)) FILTER (date_diff('day', raised, defaulted) >= 60) AS lead, max(CASE WHEN raised <= defaulted THEN 1 END) AS a FROM df LEFT JOIN al ON df.account_id = al.account_id GROUP BY ALL),
st AS (SELECT account_id, defaulted, lead, CASE WHEN lead IS NOT NULL THEN 'captured' WHEN a = 1 THEN 'too_late' ELSE 'never' END AS status FROM cp)"""


def alerts_and_defaults(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = account_months(spark, sf)
    alerts = m.filter("dpd between 30 and 89").select("account_id", F.col("snapshot").alias("raised"), F.when(F.col("dpd") >= 60, "RED").otherwise("AMBER").alias("tier"))
    return alerts, m.filter("dpd >= 90").groupBy("account_id").agg(F.min("snapshot").alias("defaulted"))


@query(f"{ALERTS} SELECT * FROM st")
def ews_capture(spark: SparkSession, sf: str) -> DataFrame:
    return J.capture(*alerts_and_defaults(spark, sf))


@query(f"""{ALERTS}, o AS (SELECT lead, row_number() OVER (ORDER BY lead) AS i, count(*) OVER () AS n FROM st WHERE lead IS NOT NULL)
SELECT q, lead AS value FROM o, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q) WHERE i = greatest(ceil(CAST(q AS DOUBLE) * n), 1)""")
def ews_lead_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return J.nearest_rank_of(J.capture(*alerts_and_defaults(spark, sf)), "lead", [0.1, 0.25, 0.5, 0.75, 0.9]).withColumn("value", F.col("value").cast("bigint"))


@query(f"{ALERTS} SELECT count(*) AS hindsight FROM al SEMI JOIN df ON al.account_id = df.account_id AND al.raised >= df.defaulted")
def ews_hindsight(spark: SparkSession, sf: str) -> DataFrame:
    return J.hindsight(*alerts_and_defaults(spark, sf)).agg(F.count("*").alias("hindsight"))


@query(f"{ALERTS} SELECT tier, count(*) AS disposed, count(*) FILTER (df.account_id IS NOT NULL) AS confirmed, round(avg(CAST(df.account_id IS NOT NULL AS INTEGER)), 6) AS precision FROM al LEFT JOIN df ON al.account_id = df.account_id AND defaulted > raised GROUP BY 1")
def ews_tier_precision(spark: SparkSession, sf: str) -> DataFrame:
    alerts, defaults = alerts_and_defaults(spark, sf)
    d = defaults.select(F.col("account_id").alias("did"), "defaulted")
    j = alerts.join(d, (F.col("account_id") == F.col("did")) & (F.col("defaulted") > F.col("raised")), "left")
    hit = F.col("did").isNotNull()
    return j.groupBy("tier").agg(F.count("*").alias("disposed"), F.count(F.when(hit, 1)).alias("confirmed"), F.round(F.avg(hit.cast("int")), 6).alias("precision"))


@query(f"""{ALERTS}, r AS (SELECT account_id, raised, tier, row_number() OVER (PARTITION BY account_id % 20 ORDER BY CASE tier WHEN 'RED' THEN 0 ELSE 1 END, raised, account_id) AS place FROM al)
SELECT account_id, raised, tier, account_id % 20 AS officer, place <= 15 AS assigned FROM r""")
def ews_officer_cap(spark: SparkSession, sf: str) -> DataFrame:
    alerts, _ = alerts_and_defaults(spark, sf)
    w = Window.partitionBy("officer").orderBy(F.when(F.col("tier") == "RED", 0).otherwise(1), "raised", "account_id")
    return alerts.withColumn("officer", F.col("account_id") % 20).withColumn("assigned", F.row_number().over(w) <= 15)


WINDOWS = {"n_1h": 3600, "n_24h": 86400, "n_7d": 604800}
_VEL = f"""{EV}, p AS (SELECT event_id AS id, key, event_time AS as_of FROM ev WHERE event_type = 'signup')
SELECT p.id, p.key, """ + ", ".join(f"count(*) FILTER (epoch(p.as_of) - epoch(e.event_time) <= {w}) AS {n}" for n, w in WINDOWS.items()) + " FROM p LEFT JOIN ev e ON e.key = p.key AND e.event_time <= p.as_of AND e.event_time >= p.as_of - INTERVAL 7 DAY {x} GROUP BY ALL"


def probes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = two_clock_events(spark, sf).withColumn("event_time", F.date_trunc("second", "event_time")).withColumn("ingest_time", F.date_trunc("second", "ingest_time"))
    return ev.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), "key", F.col("event_time").alias("as_of"), F.col("event_time").alias("known_at")), ev


@query(_VEL.format(x="AND e.ingest_time <= p.as_of").replace("ts AS event_time", "date_trunc('second', ts) AS event_time").replace("  ts + to_minutes", "  date_trunc('second', ts) + to_minutes"))
def velocity_features(spark: SparkSession, sf: str) -> DataFrame:
    return J.velocity(*probes(spark, sf), WINDOWS).select("id", "key", *WINDOWS)


@query(_VEL.format(x="").replace("ts AS event_time", "date_trunc('second', ts) AS event_time"))
def velocity_features_in_hindsight(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts without the second clock: late arrivals make the difference."""
    p, ev = probes(spark, sf)
    return J.velocity(p.withColumn("known_at", F.lit("9999-01-01").cast("timestamp")), ev, WINDOWS).select("id", "key", *WINDOWS)


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS node, n_nationkey // 2 AS upstream, 1 AS depth FROM nation WHERE n_nationkey > 0 UNION ALL SELECT node, upstream // 2, depth + 1 FROM up WHERE upstream > 0) SELECT node, upstream, depth FROM up""")
def lineage_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All upstream tables of a table, nearest first, by recursion."""
    table(spark, sf, "nation").createOrReplaceTempView("granary_nation")
    return spark.sql("""WITH RECURSIVE up AS (SELECT n_nationkey AS node, n_nationkey div 2 AS upstream, 1 AS depth FROM granary_nation WHERE n_nationkey > 0
      UNION ALL SELECT node, upstream div 2, depth + 1 FROM up WHERE upstream > 0) SELECT node, upstream, depth FROM up""")
